"""Benchmark decontamination: one Aho-Corasick automaton over normalised items.

Texts and items are lower-cased (A-Z) and cut into words (0-9, a-z, non-ASCII
characters).  A window is 13 consecutive item words; a shorter item that has
words is one window.  The automaton works on word ids, is built once per Python
worker and reads each text once; hits are word positions, which map to byte
offsets of the original text because lower-casing keeps byte lengths.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockcast.llm.text import ALNUM_TABLE, ALNUM_WORD, binary, kept_rows, pieces, shipped, small_batches, spans, written

WINDOW = 13
PART_BYTES = 512 << 10  # of item texts in one automaton, which takes some 200 times as much

_HITS = pa.schema(
    [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("items", pa.list_(pa.int64())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ]
)
HIT_DDL = (
    "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<long>, spans array<struct<start:long,stop:long>>"
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(ALNUM_TABLE).split() if text else []


class Windows:
    """All windows of the items, searchable in one scan of a text's words."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[i : i + window])].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(who))))
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit intervals [first word, last word] and the items that occur."""
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.vocab or not words:
            return found, items
        # unknown words are 0, which no window holds
        ids = tuple(map(self.vocab.get, words, (0,) * len(words)))
        for end, (length, who) in self.automaton.iter(ids):
            items.update(who)
            start = end - length + 1
            while found and found[-1][1] >= start - 1:  # overlapping or touching
                start = min(start, found.pop()[0])
            found.append((start, end))
        return found, items


_BUILT: dict[int, Windows] = {}


def _built(sent) -> Windows:
    """The automaton of this worker process, built at its first use."""
    if sent.id not in _BUILT:
        _BUILT.clear()
        _BUILT[sent.id] = Windows(*sent.value)
    return _BUILT[sent.id]


class _Sent:
    """A broadcast with an id that names it in every worker."""

    def __init__(self, spark, value):
        self.handle = shipped(spark, value)
        self.id = self.handle._jbroadcast.id()

    @property
    def value(self):
        return self.handle.value

    def __getstate__(self):
        return {"handle": self.handle, "id": self.id}


def benchmark_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Callable[[], list[tuple[int, bytes]]]]:
    """Functions that fetch the distinct items as (id, UTF-8 text), in parts of about
    PART_BYTES each, an item never cut.  One part at a time is on the driver and in the
    workers."""
    b = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    b = b.where("i is not null and t is not null").distinct()
    size = b.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    at = F.pmod(F.xxhash64(F.lit(23), "i", "t"), F.lit(parts))
    return [lambda n=n: [(r.i, bytes(r.t)) for r in b.where(at == n).collect()] for n in range(parts)]


def _scanned(texts: DataFrame, items: list[tuple[int, bytes]], window: int) -> DataFrame:
    """The rows of ``texts`` (text and other columns) with n_words, and the merged word
    intervals (first, last) and items of these windows."""
    sent = _Sent(texts.sparkSession, (items, window))
    small_batches(texts.sparkSession)
    others = [c for c in texts.columns if c != "text"]
    interval = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        find = _built(sent)
        for b in pieces(batches, "text"):
            n, intervals, who = [], [], []
            for t in binary(b, "text"):
                words = words_of(t)
                found, items = find.scan(words)
                n.append(len(words))
                intervals.append([{"first": s, "last": e} for s, e in found])
                who.append(sorted(items))
            columns = [b.column(c) for c in b.schema.names] + [pa.array(n, pa.int64()), pa.array(intervals, interval), pa.array(who, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "n_words", "intervals", "items"])

    ddl = texts.select(*others, "text").schema.simpleString()[7:-1]
    added = "n_words long, intervals array<struct<first:long,last:long>>, items array<long>"
    return texts.select(*others, "text").mapInArrow(run, f"{ddl}, {added}")


def _row(i, t: bytes | None, n: int, found: list[tuple[int, int]], items) -> tuple:
    """A result row from a text's merged hit intervals and items."""
    n_hit = sum(e - s + 1 for s, e in found)
    where = []
    if found:
        at, end = spans(np.frombuffer(t.lower(), np.uint8), ALNUM_WORD)
        where = [{"start": int(at[s]), "stop": int(end[e])} for s, e in found]
    names = ",".join(sorted(map(str, items)))
    return i, n, n_hit, len(items), hashlib.sha256(names.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n, sorted(items), where


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HITS)], schema=_HITS)


def _found(rows: DataFrame, items: list[tuple[int, bytes]], window: int) -> DataFrame:
    """The result for a benchmark of one part, in one pass."""
    sent = _Sent(rows.sparkSession, (items, window))
    small_batches(rows.sparkSession)

    def run(batches):
        find = _built(sent)
        for b in pieces(batches, "text"):
            out = []
            for i, t in zip(b.column("id").to_pylist(), binary(b, "text")):
                words = words_of(t)
                out.append(_row(i, t, len(words), *find.scan(words)))
            yield _batch(out)

    return rows.mapInArrow(run, HIT_DDL)


def _judged(rows: DataFrame) -> DataFrame:
    """The result from id, text, n_words, intervals, items."""

    def run(batches):
        for b in pieces(batches, "text"):
            cols = (b.column(c).to_pylist() for c in ("id", "n_words", "intervals", "items"))
            out = []
            for i, n, intervals, items, t in zip(*cols, binary(b, "text")):
                out.append(_row(i, t, n, union_of([(x["first"], x["last"]) for x in intervals]), set(items)))
            yield _batch(out)

    return rows.mapInArrow(run, HIT_DDL)


def union_of(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals merged where they overlap or touch, ascending."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256,
    contaminated, items, spans (byte offsets in the original UTF-8 text).

    Null and empty texts have no words and are clean.  Items with a null id or
    text, or without words, have no window.  Repeated rows each get a row;
    repeated items count once.  Other columns of either side are ignored.
    ``contaminated``: n_hit > 0 and 20 * n_hit >= n_words.

    A benchmark beyond PART_BYTES is gone through in parts, one scan of the texts for
    each; the hits of a text, which are named by a hash of it, are then brought together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = benchmark_parts(benchmark)
    if len(parts) == 1:
        return _found(rows, parts[0](), window)
    named = rows.withColumn("name", _name(F.col("text")))
    hits = _hits(named.drop("id"), parts, window).drop("n_words")
    whole = _scanned(named, [], window).drop("intervals", "items").join(hits, "name", "left")
    none = {c: F.coalesce(c, F.array().cast(t)) for c, t in (("intervals", "array<struct<first:long,last:long>>"), ("items", "array<long>"))}
    return _judged(whole.withColumns(none).drop("name"))


def _name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hits(named: DataFrame, parts: list, window: int) -> DataFrame:
    """(name, n_words, intervals, items) of the texts (name, text) that any part hits;
    of one text there are no more intervals than its words for each part."""
    hits = None
    for part in parts:
        found = _scanned(named, part(), window).where("size(items) > 0")
        # equal texts have equal hits
        found = written(found.drop("text").dropDuplicates(["name"]), "contamination")
        hits = found if hits is None else hits.unionByName(found)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("intervals", "items")]
    return hits.groupBy("name").agg(F.first("n_words").alias("n_words"), *lists)


def _bad_names(batches):
    for b in batches:
        bad = []
        for name, n, intervals in zip(*(b.column(c).to_pylist() for c in ("name", "n_words", "intervals"))):
            n_hit = sum(e - s + 1 for s, e in union_of([(x["first"], x["last"]) for x in intervals]))
            if 20 * n_hit >= n:
                bad.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["bad"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows, its columns unchanged.  Each row is judged by
    its own text, whatever its id and other rows with the same one."""
    parts = benchmark_parts(benchmark)
    text = F.col(text_col).cast("string")
    if len(parts) == 1:
        sent = _Sent(docs.sparkSession, (parts[0](), window))

        def judge():
            find = _built(sent)

            def clean(t: bytes | None) -> bool:
                words = words_of(t)
                n_hit = sum(e - s + 1 for s, e in find.scan(words)[0])
                return not (n_hit > 0 and 20 * n_hit >= len(words))

            return clean

        return kept_rows(docs, text_col, judge)
    named = docs.select(_name(text).alias("name"), text.alias("text"))
    bad = _hits(named, parts, window).select("name", "n_words", "intervals").mapInArrow(_bad_names, "bad string")
    return docs.join(bad, _name(text) == bad["bad"], "left_anti")
