import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexanchor.llm import bpe

RANKS = os.path.join(bpe.DEFAULT_TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_equals_reference(reference, texts):
    assert bpe.load_encoder(RANKS).encode_batch(texts).to_pylist() == [reference(t.encode("utf-8", "replace").decode()) for t in texts]


def test_long_words_and_special_strings(reference):
    rng = random.Random(1)
    texts = ["a" * 5000, "é" * 999, " " * 3000, "ab" * 700 + "!?" * 300, "<|endoftext|>", "", "it's we'll"]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(k)) for k in (90, 95, 96, 97, 98, 500)]
    assert bpe.load_encoder(RANKS).encode_batch(texts).to_pylist() == [reference(t) for t in texts]


def test_query_form(spark, reference):
    data = [(1, "Été à Aix", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (1, "Été à Aix", "x"), (5, "mot " * 20000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode_corpus(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted((i, reference(t or "")) for i, t, _ in data)
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
