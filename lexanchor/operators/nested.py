"""Deeply nested records as flat tables that keep the link from parent to child.

Each record is parsed as a stream into triples ``(path, ordinals, value)``: the path of
element names, the ordinal of each step among its like-named siblings, and the text. The
paths are grouped by their nearest repeated ancestor, and each group is pivoted into one
table keyed by the record and the ancestor's ordinals, of which those of its own repeated
ancestors are the key of the parent. XML and JSON payloads and typed nested columns of any
shape become the same triples, which are kept as columns: typed columns are shredded by the
list offsets of their Arrow arrays, without a Python loop over rows.

All triples of one record are made in one task, so the pivot needs no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Path = tuple[str, ...]
Triple = tuple[int, Path, tuple[int, ...], str]


@dataclass(frozen=True)
class Shape:
    """Elements that are records, paths within a record that repeat, and where the parts of a term stand."""

    roots: tuple[str, ...]
    repeated: tuple[Path, ...]  # a concept, a term
    record_id: tuple[Path, ...]
    concept_id: Path
    term_text: Path


# Element names of the vocabulary's source records and field names of its typed tables.
SOURCE_SHAPE = Shape(
    roots=("DescriptorRecord", "SupplementalRecord"),
    repeated=(("ConceptList", "Concept"), ("ConceptList", "Concept", "TermList", "Term")),
    record_id=(("DescriptorUI",), ("SupplementalRecordUI",)),
    concept_id=("ConceptUI",),
    term_text=("String",),
)
TABLE_SHAPE = Shape(
    roots=(),
    repeated=(("concepts",), ("concepts", "terms")),
    record_id=(("ui",),),
    concept_id=("ui",),
    term_text=("String",),
)


# --- streams to triples


def xml_triples(payload: str, roots: tuple[str, ...]) -> list[Triple]:
    """Triples of every record in an XML payload, attributes as steps ``@name``; raises ValueError if it isn't well-formed."""
    out: list[Triple] = []
    names: list[str] = []
    ordinals: list[int] = []
    counters: list[dict[str, int]] = [{}]
    texts: list[list[str]] = []
    state = {"record": -1, "depth": -1}

    def opened(name: str, attributes: dict) -> None:
        seen = counters[-1]
        ordinals.append(seen.get(name, 0))
        seen[name] = ordinals[-1] + 1
        names.append(name)
        counters.append({})
        texts.append([])
        if state["depth"] < 0 and name in roots:
            state["record"] += 1
            state["depth"] = len(names)
        if state["depth"] >= 0:
            depth = state["depth"]
            for key, value in attributes.items():
                out.append((state["record"], (*names[depth:], f"@{key}"), (*ordinals[depth:], 0), value))

    def closed(_name: str) -> None:
        depth = state["depth"]
        if 0 <= depth < len(names):
            out.append((state["record"], tuple(names[depth:]), tuple(ordinals[depth:]), "".join(texts[-1])))
        if depth == len(names):
            state["depth"] = -1
        for stack in (names, ordinals, counters, texts):
            stack.pop()

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler = opened
    parser.EndElementHandler = closed
    parser.CharacterDataHandler = lambda data: texts[-1].append(data)
    try:
        parser.Parse(payload.encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, UnicodeError, ValueError) as error:
        raise ValueError(str(error)) from None
    return out


_TOKEN = re.compile(
    r"""[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([{}\[\],:]))"""
)
_END = re.compile(r"[ \t\n\r]*\Z")


def json_events(payload: str) -> Iterator[tuple[str, str]]:
    """Events of a JSON text, read from left to right: "{", "}", "[", "]", key and value; raises ValueError where it isn't well-formed."""
    at, stack, expect = 0, [], "value"  # what may follow: value, key, colon, comma, or the end of an empty container
    while stack or expect != "done":
        found = _TOKEN.match(payload, at)
        if not found:
            raise ValueError(f"at {at}")
        at = found.end()
        text, scalar, sign = found.groups()
        if expect in ("value", "value or ]") and sign in ("{", "["):
            stack.append(sign)
            yield sign, ""
            expect = "key or }" if sign == "{" else "value or ]"
        elif (expect, sign) in (("key or }", "}"), ("comma", "}"), ("value or ]", "]"), ("comma", "]")) and stack[-1] == ("{" if sign == "}" else "["):
            stack.pop()
            yield sign, ""
            expect = "comma" if stack else "done"
        elif expect in ("key", "key or }") and text is not None:
            yield "key", json.loads(text) if "\\" in text else text[1:-1]
            expect = "colon"
        elif expect == "colon" and sign == ":":
            expect = "value"
        elif expect == "comma" and sign == ",":
            expect = "key" if stack[-1] == "{" else "value"
        elif expect in ("value", "value or ]") and sign is None:
            yield "value", (json.loads(text) if "\\" in text else text[1:-1]) if text is not None else "" if scalar == "null" else scalar
            expect = "comma" if stack else "done"
        else:
            raise ValueError(f"at {at}")
    if not _END.match(payload, at):
        raise ValueError(f"at {at}")


def json_triples(payload: str, roots: tuple[str, ...]) -> list[Triple]:
    """Triples of every record in a JSON payload; raises ValueError if it isn't well-formed.

    A list's items are like-named siblings; a list within a list is one more step "item"; a
    repeated key goes on counting. Null is the empty text, other scalars are as written.
    """
    out: list[Triple] = []
    record = -1
    # of each open container: its kind, and within a record its path, ordinals and counters; None outside of records
    stack: list[tuple[str, list | None]] = []
    key = ""

    def child() -> tuple[Path, tuple[int, ...]] | None:
        """Path and ordinals of a value that begins here; None outside of records."""
        nonlocal record
        if not stack:
            return None
        kind, place = stack[-1]
        if place is None:
            if kind == "{" and key in roots:
                record += 1
                return (), ()
            return None
        path, ordinals, counters = place
        if kind == "roots":
            record += 1
            return (), ()
        if kind == "{":
            n = counters[key] = counters.get(key, -1) + 1
            return (*path, key), (*ordinals, n)
        n = counters[""] = counters.get("", -1) + 1
        if kind == "[":
            return (*path, "item"), (*ordinals, n)
        return path, (*ordinals[:-1], ordinals[-1] + n)  # items of a named list

    for kind, text in json_events(payload):
        if kind == "key":
            key = text
        elif kind == "value":
            place = child()
            if place and place[0]:
                out.append((record, *place, text))
        elif kind == "{":
            place = child()
            if place and place[0]:
                out.append((record, *place, ""))
            stack.append(("{", None if place is None else [*place, {}]))
        elif kind == "[":
            outer = stack[-1] if stack else ("", None)
            if outer[1] is None and outer[0] == "{" and key in roots:
                stack.append(("roots", [(), (), {}]))
                continue
            place = child()
            if place is None:
                stack.append(("[", None))
            elif outer[0] == "{" and outer[1] is not None:
                stack.append(("named", [*place, {}]))
            else:
                if place[0]:
                    out.append((record, *place, ""))
                stack.append(("[", [*place, {}]))
        else:
            closed, place = stack.pop()
            if closed == "named":  # the name, should it come again, goes on counting
                path, ordinals, counters = place
                stack[-1][1][2][path[-1]] = ordinals[-1] + counters.get("", -1)
    return out


def payload_triples(payload: str | None, fmt: str | None, roots: tuple[str, ...]) -> list[Triple]:
    """Triples of a payload; none for a null or one that isn't well-formed."""
    if payload is None:
        return []
    kind = (fmt or "").strip().lower()
    if kind not in ("xml", "json"):
        kind = "xml" if payload.lstrip()[:1] == "<" else "json"
    try:
        return (xml_triples if kind == "xml" else json_triples)(payload, roots)
    except ValueError:
        return []


# --- triples as columns, grouped and pivoted


def _safe(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


@dataclass
class Triples:
    """Columns of triples; ordinals are padded with -1 to the longest path."""

    paths: list[Path]
    path: np.ndarray
    record: np.ndarray
    ordinals: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, triples: list[Triple]) -> Triples:
        known: dict[Path, int] = {}
        code = [known.setdefault(path, len(known)) for _, path, _, _ in triples]
        width = max(map(len, known), default=1)
        ordinals = [(*nth, *[-1] * (width - len(nth))) for _, _, nth, _ in triples]
        return cls(
            list(known), np.array(code, np.int64), np.array([t[0] for t in triples], np.int64),
            np.array(ordinals, np.int64).reshape(len(triples), width), np.array([_safe(t[3]) for t in triples], object),
        )


def repeated_paths(triples: Triples, declared: Iterable[Path] = ()) -> list[Path]:
    """Paths that stand more than once under one parent, and those that are declared to."""
    found = set(declared)
    for k, path in enumerate(triples.paths):
        own = triples.ordinals[triples.path == k]
        found |= {path[:depth] for depth in range(1, len(path) + 1) if len(own) and own[:, depth - 1].max() > 0}
    return sorted(found)


def nearest_ancestor(path: Path, repeated: Iterable[Path]) -> Path:
    """The longest repeated path that the path begins with, itself included; () for none."""
    return max((r for r in repeated if path[: len(r)] == r), key=len, default=())


@dataclass
class Group:
    """One table: its keys (record, then the ordinals down to its ancestor) in order, and for each relative path its values."""

    ancestor: Path
    keys: np.ndarray
    columns: dict[Path, np.ndarray]

    def column(self, *names: Path) -> np.ndarray:
        """The values of the first of the relative paths that a row has, "" where it has none."""
        out = np.full(len(self.keys), None, object)
        for name in names:
            if name in self.columns:
                out = np.where(pd.isnull(out), self.columns[name], out)
        return np.where(pd.isnull(out), "", out)

    def rows_of(self, child: Group) -> np.ndarray:
        """For each row of a table further down the row of this one that it belongs to, -1 for none."""
        width = self.keys.shape[1]
        both = np.concatenate([self.keys, child.keys[:, :width]])
        _, code = np.unique(both, axis=0, return_inverse=True)
        code = code.reshape(-1)
        at = np.full(len(both), -1)
        at[code[: len(self.keys)]] = np.arange(len(self.keys))
        return at[code[len(self.keys) :]]


def pivot(triples: Triples, repeated: Iterable[Path]) -> dict[Path, Group]:
    """Every group of paths of one nearest repeated ancestor as a table; of values of one path in a row the first stands."""
    repeated = list(repeated)
    groups: dict[Path, list[int]] = {(): []}
    for k, path in enumerate(triples.paths):
        groups.setdefault(nearest_ancestor(path, repeated), []).append(k)
    out = {}
    for ancestor, members in groups.items():
        depth = len(ancestor)
        at = np.flatnonzero(np.isin(triples.path, members))
        every = np.concatenate([triples.record[at, None], triples.ordinals[at, :depth]], axis=1)
        keys, row = np.unique(every, axis=0, return_inverse=True) if len(at) else (every, np.empty(0, np.int64))
        row = row.reshape(-1)
        columns = {}
        for k in members:
            own = np.flatnonzero(triples.path[at] == k)
            own = own[np.lexsort(triples.ordinals[at[own]].T[::-1])][::-1]  # the first is written last
            values = np.full(len(keys), None, object)
            values[row[own]] = triples.value[at[own]]
            columns[triples.paths[k][depth:]] = values
        out[ancestor] = Group(ancestor, keys, columns)
    return out


def linked_terms(triples: Triples, shape: Shape) -> pd.DataFrame:
    """Record, concept and term tables of some records, joined by their keys: one row per term that isn't blank."""
    tables = pivot(triples, shape.repeated)
    concept, term = shape.repeated
    empty = Group((), np.empty((0, 1), np.int64), {})
    if term not in tables:
        return pd.DataFrame([], columns=COLUMNS)
    terms, concepts, records = tables[term], tables.get(concept, empty), tables[()]
    text = terms.column(shape.term_text, ())

    def parent(table: Group, *names: Path) -> np.ndarray:
        if not len(table.keys):
            return np.full(len(terms.keys), "", object)
        at = table.rows_of(terms)
        return np.where(at >= 0, table.column(*names)[at], "")

    columns = (parent(records, *shape.record_id), terms.keys[:, len(concept)], parent(concepts, shape.concept_id), terms.keys[:, -1], text)
    kept = np.array([bool(t.strip()) for t in text], bool)
    return pd.DataFrame({name: column[kept].tolist() for name, column in zip(COLUMNS, columns, strict=True)})


SCHEMA = "record_ui string, concept_pos long, concept_ui string, term_pos long, term string"
COLUMNS = ["record_ui", "concept_pos", "concept_ui", "term_pos", "term"]
TRIPLES = "record_key string, record_no long, path string, ordinals array<long>, value string"


# --- typed columns to triples


def _shred(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Flattened children of a list array with the ordinal of each and its parent's row."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    counts = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    parent = np.repeat(np.arange(len(counts)), counts)
    return lists.flatten(), parent, np.arange(len(parent)) - starts[parent]


def column_triples(
    column: pa.Array, path: Path, record: np.ndarray, ordinals: np.ndarray, listed: bool = False
) -> Iterator[tuple[Path, np.ndarray, np.ndarray, np.ndarray]]:
    """``(path, record, ordinals, values)`` of a column of any nested type; nulls give no triple, but keep positions."""
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        items, parent, nth = _shred(column)
        inner = ordinals[parent]
        if listed:  # a list within a list
            path, inner = (*path, "item"), np.column_stack([inner, nth])
        else:
            inner[:, -1] = nth
        yield from column_triples(items, path, record[parent], inner, True)
        return
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if pa.types.is_struct(kind):
        yield path, record[there], ordinals[there], np.full(len(there), "", object)
        taken = column.take(pa.array(there))
        for k in range(kind.num_fields):
            deeper = np.column_stack([ordinals[there], np.zeros(len(there), np.int64)])
            yield from column_triples(taken.field(k), (*path, kind.field(k).name), record[there], deeper)
        return
    values = pc.cast(column, pa.string()).take(pa.array(there)).to_numpy(zero_copy_only=False)
    yield path, record[there], ordinals[there], np.asarray(values, object)


def batch_triples(batch: pa.RecordBatch) -> Triples:
    """Triples of the rows of a batch, its columns being the first steps."""
    paths: dict[Path, int] = {}
    parts = []
    rows = np.arange(batch.num_rows)
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        for path, record, ordinals, values in column_triples(column, (name,), rows, np.zeros((batch.num_rows, 1), np.int64)):
            parts.append((paths.setdefault(path, len(paths)), record, ordinals, values))
    width = max((p[2].shape[1] for p in parts), default=1)
    padded = [np.pad(p[2], ((0, 0), (0, width - p[2].shape[1])), constant_values=-1) for p in parts]
    joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in ([np.full(len(p[1]), p[0]) for p in parts], [p[1] for p in parts], [p[3] for p in parts])]
    return Triples(list(paths), joined[0], joined[1], np.concatenate(padded) if padded else np.empty((0, width), np.int64), joined[2])


def _typed_rows(df: DataFrame, id_col: str, concepts_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("ui"), F.col(concepts_col).alias("concepts"))


def _typed(finish: Callable[[Triples], pd.DataFrame]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = finish(batch_triples(batch))
            if len(out):
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return run


def _parsed(shape: Shape, finish: Callable[[Triples], pd.DataFrame]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, records = [], 0
            for fmt, payload in pdf.itertuples(index=False):
                own = payload_triples(payload, fmt, shape.roots)
                found += [(records + t[0], *t[1:]) for t in own]
                records += max((t[0] for t in own), default=-1) + 1
            yield finish(Triples.of(found))

    return run


# --- operators


def payload_record_triples(df: DataFrame, key_col: str, fmt_col: str, payload_col: str, shape: Shape = SOURCE_SHAPE) -> DataFrame:
    """The path-value-ordinal triples of source payloads, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (key, number, "/".join(path), list(ordinals), _safe(value))
                for key, fmt, payload in pdf.itertuples(index=False)
                for number, path, ordinals, value in payload_triples(payload, fmt, shape.roots)
            ]
            yield pd.DataFrame(rows, columns=["record_key", "record_no", "path", "ordinals", "value"])

    return df.select(F.col(key_col).cast("string"), fmt_col, payload_col).mapInPandas(run, TRIPLES)


def table_record_triples(df: DataFrame, id_col: str, concepts_col: str = "concepts") -> DataFrame:
    """The same triples of a typed table, each row a record by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch_triples(batch)
            keys = batch.column(0).take(pa.array(t.record))
            names = pa.array(["/".join(p) for p in t.paths], pa.string()).take(pa.array(t.path))
            ordinals = [row[row >= 0] for row in t.ordinals]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.zeros(len(t.record), np.int64)), names, pa.array(ordinals, pa.list_(pa.int64())), pa.array(t.value, pa.string())],
                names=["record_key", "record_no", "path", "ordinals", "value"],
            )

    return _typed_rows(df, id_col, concepts_col).mapInArrow(run, TRIPLES)


def payload_terms(df: DataFrame, fmt_col: str, payload_col: str, shape: Shape = SOURCE_SHAPE) -> DataFrame:
    """One row per non-blank term of every record in XML or JSON payloads.

    Null, empty and malformed payloads give no rows; a missing identifier is ''; repeated
    payloads give one set of rows; blank terms keep their position.
    """
    rows = df.select(F.col(fmt_col).cast("string"), F.col(payload_col).cast("string"))
    return rows.mapInPandas(_parsed(shape, lambda t: linked_terms(t, shape)), SCHEMA).distinct()


def table_terms(df: DataFrame, id_col: str, concepts_col: str = "concepts") -> DataFrame:
    """One row per non-blank term of a typed table, by the triples of its nested columns.

    Null and empty lists, null concepts and blank terms give no rows but keep positions; a
    null identifier is ''; repeated rows give one set of rows; other columns are ignored.
    """
    return _typed_rows(df, id_col, concepts_col).mapInArrow(_typed(lambda t: linked_terms(t, TABLE_SHAPE)), SCHEMA).distinct()


def vocabulary_terms(descriptors: DataFrame, supplementals: DataFrame, records: DataFrame) -> DataFrame:
    """Terms of the two typed tables and of the source payloads as one flat table, each row once."""
    return (
        table_terms(descriptors, "dui")
        .unionByName(table_terms(supplementals, "sui"))
        .unionByName(payload_terms(records, "fmt", "payload"))
        .distinct()
    )


def nested_tables(triples: DataFrame, declared: Iterable[Path] = ()) -> dict[str, DataFrame]:
    """One table per group of paths of ``triples`` (as ``payload_record_triples`` gives them), named by the repeated ancestor.

    What repeats is found over all records, or declared. Each table has ``record_key``,
    ``record_no``, an array ``key`` of the ordinals down to its ancestor, ``parent`` with those
    down to the next ancestor, and a column per path within the group ("" for the ancestor's own
    text is ``value``). Only names and greatest ordinals of paths, which the records' schema
    bounds, reach the driver.
    """
    found = triples.select("path", F.posexplode("ordinals").alias("depth", "n")).groupBy("path", "depth").agg(F.max("n").alias("most")).collect()
    paths = sorted({tuple(r["path"].split("/")) for r in found})
    repeated = sorted({tuple(r["path"].split("/")[: r["depth"] + 1]) for r in found if r["most"]} | {p for p in declared if any(q[: len(p)] == p for q in paths)})
    groups: dict[Path, list[Path]] = {}
    for path in paths:
        groups.setdefault(nearest_ancestor(path, repeated), []).append(path)
    out = {}
    for ancestor, members in groups.items():
        depth, above = len(ancestor), len(nearest_ancestor(ancestor[:-1], repeated)) if ancestor else 0
        own = triples.where(F.col("path").isin(["/".join(p) for p in members]))
        own = own.select("record_key", "record_no", F.slice("ordinals", 1, depth).alias("key"), "path", "ordinals", "value")
        columns = [F.min(F.when(F.col("path") == "/".join(p), F.struct("ordinals", "value"))).alias("/".join(p[depth:]) or "value") for p in members]
        table = own.groupBy("record_key", "record_no", "key").agg(*columns)
        names = [c for c in table.columns if c not in ("record_key", "record_no", "key")]
        out["/".join(ancestor)] = table.select("record_key", "record_no", "key", F.slice("key", 1, above).alias("parent"), *[F.col(f"`{c}`")["value"].alias(c) for c in names])
    return out
