import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexanchor.llm import leakage as L
from tests.conftest import rows


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=20), st.lists(st.integers(0, 5), max_size=30))
def test_bit_parallel_distance(pattern, text):
    assert L.myers(np.array(pattern), np.array(text, np.int64)) == distance(pattern, text)


def brute(items, texts, rules):
    out = set()
    for d, text in enumerate(texts):
        for i, (_, item) in enumerate(items):
            for span, budget in rules:
                if any(distance(item[s : s + span], text) <= budget for s in range(len(item) - span + 1)):
                    out.add((d, i))
    return sorted(out)


def make():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.randrange(18, 50))]) for k in range(12)]
    texts = []
    for _ in range(60):
        item = rng.choice(items)[1]
        span = rng.randrange(8, 30)
        at = rng.randrange(max(1, len(item) - span))
        part = item[at : at + span]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(part))
            part = part[:k] + rng.choice([[], ["zz"], ["zz", part[k]]]) + part[k + 1 :]
        texts.append([rng.choice(vocabulary) for _ in range(15)] + part + [rng.choice(vocabulary) for _ in range(15)])
    return items, texts


def test_equals_brute_force():
    items, texts = make()
    want = brute(items, texts, L.RULES)
    index = L.build_index(items)
    assert len(want) > 15 and L.leaks(index, texts) == want


def test_budget_grows_with_the_passage():
    item = [f"w{k}" for k in range(40)]
    index = L.build_index([(0, item)])
    for span, changed in ((30, (13, 14, 15)), (28, (9, 14, 18)), (36, (10, 16, 19, 25)), (30, (11, 13, 15, 17))):
        text = ["a"] * 9 + ["zz" if k in changed else item[k] for k in range(span)] + ["b"] * 9
        want = [(0, 0)] if len(changed) * 9 <= span else []
        assert brute([(0, item)], [text], ((18, 1), (20, 2))) == []
        assert L.leaks(index, [text]) == want


def test_no_leak_and_text_keys(spark):
    docs = spark.createDataFrame([("a", "un texte"), ("b", None)], "doc_id string, text string")
    held = spark.createDataFrame([("x", " ".join(f"w{k}" for k in range(30)))], "item_id string, text string")
    assert rows(L.find_leaks(docs, held)) == []
    assert rows(L.find_leaks(docs.unionByName(held.withColumnRenamed("item_id", "doc_id")), held)) == [("x", "x")]


def test_query_form_and_blocks(spark):
    items, texts = make()
    passage = " ".join(items[0][1][:18])
    data = [(k, " ".join(t), 1) for k, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (902, "<p>" + passage.upper().replace(" ", "  <b>") + "</p>", 1), (902, "<p>" + passage.upper().replace(" ", "  <b>") + "</p>", 1), (903, "mot " * 30000 + passage, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, item_id int")
    held = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items] + [(77, None, "x"), (78, "too short", "x"), (None, passage, "x")], "item_id long, text string, split string")
    index = L.build_index(items)
    want = sorted({(d, int(index.item_ids[i])) for d, i in L.leaks(index, texts)} | {(902, 0), (903, 0)})
    assert rows(L.find_leaks(docs, held)) == want
    assert rows(L.find_leaks(docs, held, most_chars=300)) == want  # joined, not broadcast
    assert rows(L.find_leaks(docs, held.limit(0), most_chars=-1)) == [] == rows(L.find_leaks(docs.limit(0), held, most_chars=-1))
    assert rows(L.find_leaks(docs, held.limit(0))) == [] == rows(L.find_leaks(docs.limit(0), held))


def test_stock_phrase_of_many_items(spark, monkeypatch):
    """A phrase of every item is expanded bit by bit, and long tags don't break a passage."""
    phrase = [f"p{k}" for k in range(18)]
    items = [(k, [f"a{k}"] * 5 + phrase + [f"b{k}"] * 5) for k in range(60)]
    docs = [(d, " ".join([f"d{d}"] * 4 + phrase)) for d in range(40)] + [(99, "x <span data='" + "y" * 900 + "'>" + " <b>".join(phrase))]
    want = sorted((d, k) for d, _ in docs for k, _ in items)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    monkeypatch.setattr(L, "BLOCK_HITS", 101)
    assert L.leaks(L.build_index(items), [t.split() for _, t in docs[:2]]) == sorted((d, k) for d in range(2) for k in range(60))
    assert rows(L.find_leaks(a, b)) == want == rows(L.find_leaks(a, b, most_chars=0))
