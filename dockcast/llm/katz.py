"""Katz backoff language model of any order, scored over whole texts.

Tokens are white-space words with A-Z lower-cased, then one end for each text; the
first word stands after a start.  Counts come from the training rows.  Counts up to
K get the Good-Turing discount of Katz; larger ones keep the absolute discount of
count K, so that every context leaves some mass.  An n-gram that was not seen gets
its context's backoff weight times the probability after a context shorter by one
word, and so on down to the word alone; a word that was not seen shares what the
discounts leave over.  The weights are computed from the very sums they must
complete, so the probabilities after each context add up to one.

Texts are first written as blocks of token streams (about a million tokens with
their own vocabulary).  N-grams and contexts of all blocks are then summed by key in
buckets and each block gets back the totals of its own keys (``blocks``): what is
shuffled is one entry for each distinct n-gram and block, however hot a word, an
n-gram or a text is.  A context that no other block has (a lone one) has all its
n-grams in there, so the block itself computes its weight.

The model is stored in two tables, counts and backoff weights, each with a folder
for each order; a row is a bucket's or, of lone contexts, a block's sorted keys and
their values.  Texts that had no part in the training are scored from these tables
alone.

Disk is what limits the size of the input: orders are counted one after the other,
blocks are scored once for all orders and contexts weighed in ``PARTS`` turns, and what no later turn
reads is removed, shuffles included.  The model's rows are written once, in place.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.llm.blocks import (
    Merged, buckets_of, from_coded, from_counts, from_planes, keys_from_bytes, keys_to_bytes, ranked, slices, to_coded, to_counts, to_plain, to_planes,
)
from dockcast.llm.text import _BASE, SPACE_WORD, binary, mix, pieces, scratch, small_batches, span_hashes, spans
from dockcast.session import remove

K = 5
PARTS = 8
BLOCK_TOKENS = 1 << 19
BUCKET_TOKENS = 1 << 19
RUN_BYTES = 1 << 16  # of texts that are hashed as one
# keys of the end token and of the context that stands before the first word
END, START = np.uint64(1), np.uint64(2)
WORD = 0  # kind of a single word; that of an n-gram is n - 1
MODEL = -1  # block number of the model's own rows

_BLOCK_DDL = "block long, ids array<long>, held array<boolean>, lengths array<long>, vocab binary, tokens binary, n long"
_ASK_DDL = "kind int, bucket long, block long, keys binary, counts binary"
_SUMS = [*(f"n{r}" for r in range(1, K + 2)), "types", "tokens", "tail_types", "tail_tokens"]
_ANSWER_DDL = "kind int, bucket long, block long, counts binary, own binary, lone binary"
_MODEL_DDL = "kind int, bucket long, block long, keys binary, value binary"
_SUMS_DDL = "sums array<long>"
_TOLD_DDL = f"{_ANSWER_DDL}, keys binary, value binary, {_SUMS_DDL}"
# a block's texts, and one row for each order of what it says of its contexts:
# weights of lone ones (own), sums towards those of others (sums), weights it needs (asks)
_TEXT_DDL = (
    "ids array<long>, held array<boolean>, lengths array<long>, known array<long>, base array<double>, part array<double>, "
    "gap_doc binary, gap_context binary, gap_count binary"
)
_SCORED_DDL = f"what string, kind int, block long, keys binary, value binary, seen binary, lower binary, total binary, {_TEXT_DDL}"
_CUT = ["keys", "value", "seen", "lower", "total"]
_CUT_DDL = "kind int, bucket long, block long, " + ", ".join(f"{c} binary" for c in _CUT)
_WEIGHT_DDL = "kind int, bucket long, block long, weights binary"
_OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class Order:
    """Discounts of one order, from how many types have each count."""

    def __init__(self, row: dict):
        n = [0, *(row.get(f"n{r}") or 0 for r in range(1, K + 2))]
        self.types, self.tokens = row.get("types") or 0, row.get("tokens") or 0
        d = [0.0] * (K + 1)
        ok = all(n[1:])
        if ok:
            a = (K + 1) * n[K + 1] / n[1]
            ok = a < 1
        if ok:
            d[1:] = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, K + 1)]
            ok = all(0 < x < 1 for x in d[1:])
        if not ok:  # too few types to estimate from: half a count off
            d[1:] = [1 - 0.5 / r for r in range(1, K + 1)]
        self.discount = np.array(d)
        self.off = K * (1 - d[K])  # absolute, for counts above K
        kept = sum(d[r] * r * n[r] for r in range(1, K + 1))
        kept += (row.get("tail_tokens") or 0) - self.off * (row.get("tail_types") or 0)
        self.left = 1 - kept / self.tokens if self.tokens else 1.0

    def reduced(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts; 0 stays 0."""
        out = (self.discount * np.arange(K + 1))[np.minimum(counts, K).astype(np.int64)]
        more = np.flatnonzero(counts > K)
        out[more] = counts[more] - self.off
        return out


def _stream(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """vocabulary keys, tokens, contexts (both as vocabulary positions), document of
    each token and its place in there."""
    vocab = keys_from_bytes(row["vocab"])
    tokens = from_planes(row["tokens"], np.uint32).astype(np.int64)
    lengths = np.asarray(row["lengths"], np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[starts] = np.searchsorted(vocab, START)
    return vocab, tokens, context, doc, np.arange(len(tokens)) - starts[doc]


class Level(NamedTuple):
    """Distinct n-grams of a block, sorted by key."""

    keys: np.ndarray
    context: np.ndarray  # all but the last word, as a position in the level below
    lower: np.ndarray  # all but the first word, likewise
    where: np.ndarray  # the n-gram that ends at each token; -1 where the text has none


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each among them."""
    order, by_key = ranked(a)
    new = np.ones(len(a), bool)
    np.not_equal(by_key[1:], by_key[:-1], out=new[1:])
    found = np.empty(len(a), np.int64)
    found[order] = np.cumsum(new) - 1
    return by_key[new], found


def _grams(vocab, tokens, context, place, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2 .. ``order`` words: the tokens that end an n-gram of their text, and the
    key of each one's; the start counts as a word."""
    words = vocab[tokens]
    keys = np.empty_like(words)
    for k in range(2, order + 1):
        here = np.flatnonzero(place >= k - 2)
        before = vocab[context] if k == 2 else keys[here - 1]
        before *= np.uint64(_BASE)
        before += words if k == 2 else words[here]
        keys[here] = found = mix(before)
        yield here, found


def _levels(vocab, tokens, context, place, order: int) -> list[Level]:
    """The n-grams of 1 .. ``order`` words."""
    out = [Level(vocab, np.empty(0, np.int64), np.empty(0, np.int64), tokens)]
    for k, (here, grams) in enumerate(_grams(vocab, tokens, context, place, order), 2):
        below = out[-1]
        keys, found = _distinct(grams)
        where = np.full(len(tokens), -1, np.int64)
        where[here] = found
        before, lower = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        before[found] = context if k == 2 else below.where[here - 1]
        lower[found] = below.where[here]
        out.append(Level(keys, before, lower, where))
    return out


def _runs(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Start and end of runs of texts of about ``most`` bytes; a longer one is its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or b"") > most:
            yield start, i
            start, size = i, 0
        size += len(t or b"") + 1
    if texts:
        yield start, len(texts)


def _tokens(texts: list) -> tuple[np.ndarray, list[int]]:
    """The words of some texts, an end after each, and the number of tokens of each.
    Hashes don't depend on the place of a word, so the texts are hashed as one."""
    buf = np.frombuffer(b" ".join([t or b"" for t in texts]).lower(), np.uint8)
    starts, stops = spans(buf, SPACE_WORD)
    words = span_hashes(buf, starts, stops)
    words[words <= START] += np.uint64(16)  # keys of their own for end and start
    begun = np.searchsorted(starts, np.cumsum([len(t or b"") + 1 for t in texts]))  # words before the end of each
    ends = begun + np.arange(len(texts))
    tokens = np.empty(len(words) + len(texts), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[is_end], tokens[~is_end] = END, words
    return tokens, np.diff(ends, prepend=-1).tolist()


def _make_blocks(batches):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("vocab", pa.binary()), ("tokens", pa.binary()), ("n", pa.int64())])
    ids, held, lengths, words, n = [], [], [], [], 0

    def close():
        nonlocal ids, held, lengths, words, n
        if ids:
            vocab, tokens = _distinct(np.concatenate([np.array([END, START]), *words]))
            number = int.from_bytes(os.urandom(7), "little")  # kept by the written table
            row = (number, ids, held, lengths, keys_to_bytes(vocab), to_planes(tokens[2:].astype(np.uint32)), n)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
        ids, held, lengths, words, n = [], [], [], [], 0

    for b in pieces(batches, "text"):
        i, h, texts = b.column("id").to_pylist(), b.column("held").to_pylist(), binary(b, "text")
        for start, stop in _runs(texts, min(RUN_BYTES, BLOCK_TOKENS)):
            tokens, ends = _tokens(texts[start:stop])
            ids += i[start:stop]
            held += h[start:stop]
            words.append(tokens)
            lengths += ends
            n += len(tokens)
            if n >= BLOCK_TOKENS:
                yield from close()
    yield from close()


def _rows(batches):
    """Rows of Arrow batches as dictionaries, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def _ask(buckets: int, kinds: range, turn: int = 0, turns: int = 1):
    """A block's counts of the n-grams of some orders, for the buckets whose turn it is."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for row in _rows(batches):
            vocab, tokens, context, doc, place = _stream(row)
            learn = (~np.asarray(row["held"], bool))[doc]
            grams = _grams(vocab, tokens, context, place, kinds[-1] + 1)
            for kind in range(kinds[-1] + 1):
                here, found = next(grams) if kind else (None, None)
                if kind not in kinds:
                    continue
                if kind == WORD:
                    keys, counts = vocab, np.bincount(tokens, learn, minlength=len(vocab)).astype(np.uint32)
                    # the start is counted as often as a learned text begins
                    counts[np.searchsorted(vocab, START)] = len(row["held"]) - sum(row["held"])
                else:
                    if turns > 1:
                        due = buckets_of(found, buckets) % np.uint64(turns) == turn
                        here, found = here[due], found[due]
                    by_key, found = ranked(found)
                    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else by_key
                    keys, counts = found[first], np.add.reduceat(learn[here[by_key]], first, dtype=np.uint32)
                cuts = [x for x in slices(keys, buckets) if x[0] % turns == turn]
                out = [(kind, b, row["block"], keys_to_bytes(keys[i:j]), to_counts(counts[i:j])) for b, i, j in cuts]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _tell(group: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's keys, for each block that asked; then the model's row
    with all seen keys and the counts of counts."""
    group = group.sort_values("block")
    kind, bucket = int(group["kind"].iloc[0]), int(group["bucket"].iloc[0])
    all_keys = Merged([keys_from_bytes(k) for k in group["keys"]])
    total = all_keys.sums([from_counts(c) for c in group["counts"]])
    per_entry = total[all_keys.group]
    own = all_keys.split(all_keys.first & (per_entry > 0))
    lone = all_keys.split((np.bincount(all_keys.group) == 1)[all_keys.group])
    told = [
        {"kind": kind, "bucket": bucket, "block": b, "counts": to_counts(x), "own": np.packbits(o).tobytes(), "lone": np.packbits(a).tobytes()}
        for b, x, o, a in zip(group["block"], all_keys.split(per_entry), own, lone)
    ]
    seen = total > 0
    real = total[(all_keys.keys != START) & seen] if kind == WORD else total[seen]
    tail = real[real > K]
    sums = [*((real == r).sum() for r in range(1, K + 2)), len(real), real.sum(), len(tail), tail.sum()]
    model = {"kind": kind, "bucket": bucket, "block": MODEL, "keys": keys_to_bytes(all_keys.keys[seen]), "value": to_counts(total[seen])}
    return _frame([*told, model | {"sums": [int(v) for v in sums]}], _TOLD_DDL)


def _frame(rows: list[dict], ddl: str) -> pd.DataFrame:
    """Rows as the columns of ``ddl``; what is missing is null."""
    cols = [c.split()[0] for c in ddl.split(", ")]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in cols})


def _gather(told: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, owner and lone marks of one block, in the order of its keys."""
    mine = told[told["kind"] == kind].sort_values("bucket")
    counts = [from_counts(c) for c in mine["counts"]]
    marks = ([np.unpackbits(np.frombuffer(o, np.uint8), count=len(c)).astype(bool) for o, c in zip(mine[name], counts)] for name in ("own", "lone"))
    own, lone = (np.concatenate([np.empty(0, bool), *m]) for m in marks)
    return np.concatenate([np.empty(0), *counts]), own, lone


def _weights(given: np.ndarray, total: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 backoff weights of contexts that have given away ``given`` of their counts
    to n-grams whose last words have probability ``lower`` after the shorter context."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log10((1 - given / total) / (1 - lower))


def _score_seen(orders: list[Order]):
    """What a block's contexts have given away, and the scores of its texts, all but the
    backoff weights that other blocks know, with the contexts that wait for those."""

    def run(key, blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = blocks.iloc[0].to_dict()
        vocab, tokens, context, doc, place = _stream(row)
        n_docs = len(row["lengths"])
        words = orders[WORD]
        count, _, alone = _gather(told, WORD)
        prob = np.where(count > 0, words.reduced(count) / max(words.tokens, 1), words.left)  # of a word alone
        base = np.log10((count + 0.5) / (words.tokens + 0.5 * (words.types + 1)))
        known = count > 0
        with np.errstate(divide="ignore"):
            value = np.log10(prob)[tokens]

        out, gaps, held = [], [], 0
        levels = _levels(vocab, tokens, context, place, len(orders))
        for kind, level in enumerate(levels[1:], 1):
            below, above, lone = levels[kind - 1].keys, count, alone
            count, own, alone = _gather(told, kind)
            seen = count > 0
            ctx = above[level.context]
            cut = orders[kind].reduced(count)
            # what each context has given away, from the n-grams that this block owns
            at = np.flatnonzero(own)
            of = level.context[at]
            given = np.bincount(of, cut[at], minlength=len(below))
            lower = np.bincount(of, prob[level.lower[at]], minlength=len(below))
            has = np.zeros(len(below), bool)
            has[of] = True
            prob = np.divide(cut, ctx, out=np.zeros(len(count)), where=seen)
            weight = np.zeros(len(below))
            mine = has & lone
            weight[mine] = _weights(given[mine], above[mine], lower[mine])
            out.append({"what": "own", "kind": kind, "block": row["block"], "keys": keys_to_bytes(below[mine]), "value": to_coded(weight[mine])})
            send = has & ~lone
            out.append(
                {
                    "what": "sums", "kind": kind, "block": row["block"], "keys": keys_to_bytes(below[send]),
                    "seen": to_coded(given[send]), "lower": to_coded(lower[send]), "total": to_counts(above[send]),
                }
            )
            here = np.flatnonzero(place >= kind - 1)
            gram = level.where[here]
            # a token has its n-gram's probability; if that was not seen but its context
            # was, it takes that one's weight: what other blocks know is added later
            gap = ~seen & (ctx > 0)
            gain = np.log10(prob, out=np.zeros(len(prob)), where=seen)
            gain[gap] = weight[level.context[gap]]
            so_far = value[here]
            so_far[seen[gram]] = 0
            value[here] = so_far + gain[gram]
            gap[gap] = ~mine[level.context[gap]]
            waits = np.flatnonzero(gap[gram])
            waits, at = here[waits], level.context[gram[waits]]
            need = np.zeros(len(below), bool)
            need[at] = True
            out.append({"what": "asks", "kind": kind, "block": row["block"], "keys": keys_to_bytes(below[need])})
            # and its place among those that come back
            gaps.append((doc[waits], held + (np.cumsum(need) - 1)[at]))
            held += int(need.sum())
        # a token waits once for each order that was not seen: what is seen in one is seen in all lower ones
        cell = np.concatenate([np.empty(0, np.int64), *(d * held + at for d, at in gaps)])
        cell, times = np.unique(cell, return_counts=True)
        out.append(
            {
                "what": "texts", "block": row["block"], "ids": row["ids"], "held": row["held"], "lengths": row["lengths"],
                "known": np.bincount(doc, known[tokens], minlength=n_docs).astype(np.int64),
                "base": np.bincount(doc, base[tokens], minlength=n_docs), "part": np.bincount(doc, value, minlength=n_docs),
                "gap_doc": to_planes((cell // max(held, 1)).astype(np.uint32)), "gap_context": to_planes((cell % max(held, 1)).astype(np.uint32)),
                "gap_count": to_planes(times.astype(np.uint32)),
            }
        )
        return _frame(out, _SCORED_DDL)

    return run


def _slices(buckets: int, turn: int = 0, turns: int = 1):
    """Rows of blocks as slices for the buckets whose turn it is."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in _CUT)])

    def run(batches):
        for row in _rows(batches):
            keys = keys_from_bytes(row["keys"])
            more = [None if row[c] is None else (from_counts if c == "total" else from_coded)(row[c]) for c in _CUT[1:]]
            out = [
                (row["kind"], b, row["block"], keys_to_bytes(keys[i:j]), *(None if x is None else to_plain(x[i:j]) for x in more))
                for b, i, j in slices(keys, buckets)
                if b % turns == turn
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _weigh(group: pd.DataFrame) -> pd.DataFrame:
    """log10 backoff weights of a bucket's contexts: a row of the model."""
    group = group.sort_values("block")
    merged = Merged([keys_from_bytes(k) for k in group["keys"]])
    given, lower = (merged.sums([from_coded(x) for x in group[c]]) for c in ("seen", "lower"))
    total = np.empty(len(merged.keys))
    total[merged.group] = np.concatenate([from_coded(x) for x in group["total"]])
    row = {"kind": int(group["kind"].iloc[0]), "bucket": int(group["bucket"].iloc[0]), "block": MODEL, "keys": keys_to_bytes(merged.keys)}
    return _frame([row | {"value": to_coded(_weights(given, total, lower))}], _MODEL_DDL)


def _look_up(read, write, name: str, ddl: str):
    """Values that the model's rows of a bucket have for the keys of the blocks; 0 for others."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["value"].isna()
        keys = np.concatenate([np.empty(0, np.uint64), *(keys_from_bytes(k) for k in group["keys"][~asks])])
        values = np.concatenate([np.empty(0), *(read(v) for v in group["value"][~asks])])
        by_key, keys = ranked(keys)
        values = values[by_key]
        out = []
        for kind, bucket, block, k in group.loc[asks, ["kind", "bucket", "block", "keys"]].itertuples(index=False):
            k = keys_from_bytes(k)
            got = np.zeros(len(k))
            at = np.searchsorted(keys, k)
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == k[hit]]
            got[hit] = values[at[hit]]
            none = np.packbits(np.zeros(len(k), bool)).tobytes()
            out.append({"kind": kind, "bucket": bucket, "block": block, name: write(got), "own": none, "lone": none})
        return _frame(out, ddl)

    return run


def _finish(key, parts: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
    row = parts.iloc[0]
    weight = [from_planes(w, np.float64) for w in weights.sort_values(["kind", "bucket"])["weights"]]
    weight = np.concatenate([np.empty(0), *weight])
    doc, context, count = (from_planes(row[c], np.uint32) for c in ("gap_doc", "gap_context", "gap_count"))
    due = np.bincount(doc, weight[context] * count, minlength=len(row["ids"])) if len(doc) else np.zeros(len(row["ids"]))
    return pd.DataFrame(
        {
            "doc_id": pd.array(list(row["ids"]), dtype="Int64"), "held_out": row["held"], "n_tokens": row["lengths"], "n_known": row["known"],
            "base_score": row["base"], "score": row["part"] + due,
        }
    )


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that made them ends, not with the driver's garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _add(rows: DataFrame, path: str, *by: str) -> None:
    """Rows appended to a table with a folder for each value of some columns."""
    rows.write.mode("append").partitionBy(*by).option("compression", "zstd").parquet(path)


def _blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> str:
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text")
    )
    path = scratch(docs.sparkSession, "katz-blocks")
    _add(rows.mapInArrow(_make_blocks, _BLOCK_DDL).withColumn("turn", F.col("block") % PARTS), path, "turn")
    return path


def _orders(sums: DataFrame, order: int) -> list[Order]:
    got = {r["kind"]: r.asDict() for r in sums.groupBy("kind").agg(*[F.sum(F.col("sums")[i]).alias(c) for i, c in enumerate(_SUMS)]).collect()}
    return [Order(got.get(kind, {})) for kind in range(order)]


def _scored(blocks: DataFrame, counts: DataFrame, orders: list[Order], path: str) -> None:
    """What blocks say of an order's contexts goes to a folder of that order, the rest to
    that of the last one."""
    counts = counts.select("kind", "bucket", "block", "counts", "own", "lone")
    said = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(_score_seen(orders), _SCORED_DDL)
    _add(said.withColumn("order", F.when(F.col("what").isin("own", "sums"), F.col("kind") + 1).otherwise(len(orders))), path, "order", "what")


def _slots(rows: DataFrame, buckets: int, turn: int = 0, turns: int = 1) -> DataFrame:
    return rows.select("kind", "block", *_CUT).mapInArrow(_slices(buckets, turn, turns), _CUT_DDL)


def _finished(scored: DataFrame, model: DataFrame, orders: list[Order], buckets: int) -> DataFrame:
    """The scores, from the texts of blocks and the model's rows of backoff weights."""
    asks = _slots(scored.where("what = 'asks'"), buckets).select("kind", "bucket", "block", "keys", "value")
    look_up = _look_up(from_coded, to_planes, "weights", _WEIGHT_DDL)
    weights = asks.unionByName(model.select(*asks.columns)).groupBy("kind", "bucket").applyInPandas(look_up, _WEIGHT_DDL)
    texts = scored.where("what = 'texts'").select("block", *(c.split()[0] for c in _TEXT_DDL.split(", ")))
    done = texts.groupBy("block").cogroup(weights.groupBy("block")).applyInPandas(_finish, _OUT_DDL)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(orders[WORD].tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column, order: int = 2, model_path: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability of the whole text).

    ``held_out`` marks the rows that teach nothing (null counts as false).  Null
    and empty texts have the end token only.  Without training rows every token is
    unknown and has probability 1 under the model.  Repeated rows are texts of
    their own.  Only the named columns are read.  Empty table: no rows.  ``order``
    is the number of words of the longest n-gram.  The model is stored in
    ``model_path``, if given, for ``score_stored``; an older one there is replaced.
    """
    if order < 1:
        raise ValueError("order is 1 at least")
    spark = docs.sparkSession
    path = model_path or scratch(spark, "katz-model")
    for table in ("about", "counts", "weights"):
        remove(spark, f"{path}/{table}")
    with _shuffles_dropped(spark):
        at = _blocks(docs, id_col, text_col, held_out)
        counts, weights = ([f"{path}/{table}/order={n}" for n in range(1, order + 1)] for table in ("counts", "weights"))
        blocks = lambda: spark.read.schema(f"{_BLOCK_DDL}, turn int").parquet(at)
        told = lambda kind: spark.read.schema(f"{_TOLD_DDL}, turn int").parquet(counts[kind])
        said_ddl = f"{_SCORED_DDL.removeprefix('what string, ')}, bucket long, order int, what string"
        said = lambda kind: spark.read.schema(said_ddl).parquet(f"{path}/weights").where(F.col("order") == kind + 1)
        tokens, n_blocks = blocks().agg(F.sum("n"), F.count("n")).first()
        buckets = max(1, -(-(tokens or 0) // BUCKET_TOKENS))
        turns = max(1, min(PARTS, n_blocks // 4))
        orders = []
        for kind in range(order):
            passes = min(turns, 1 if kind < 2 else 2)
            for i in range(passes):
                asked = blocks().mapInArrow(_ask(buckets, range(kind, kind + 1), i, passes), _ASK_DDL)
                answers = asked.groupBy("kind", "bucket").applyInPandas(_tell, _TOLD_DDL)
                _add(answers.withColumn("turn", F.when(F.col("block") == MODEL, MODEL).otherwise(F.col("block") % PARTS)), counts[kind], "turn")
            orders.append(_orders(told(kind).where(F.col("turn") == MODEL), kind + 1)[kind])
        for i in range(turns):
            mine = [n for n in range(PARTS) if n % turns == i]
            answers = [told(kind).where(F.col("turn").isin(mine)) for kind in range(order)]
            for more in answers[1:]:
                answers[0] = answers[0].unionByName(more)
            _scored(blocks().where(F.col("turn").isin(mine)), answers[0], orders, f"{path}/weights")
            for folder in [at, *counts]:
                for n in mine:
                    remove(spark, f"{folder}/turn={n}")
        for kind in range(1, order):
            # the sums of all orders lie there until the first are weighed
            passes = min(turns, 4 if kind == order - 1 else PARTS)
            for i in range(passes):
                sums = _slots(said(kind).where("what = 'sums'"), buckets, i, passes)
                _add(sums.groupBy("kind", "bucket").applyInPandas(_weigh, _MODEL_DDL).withColumn("what", F.lit("shared")), weights[kind], "what")
            remove(spark, f"{weights[kind]}/what=sums")
        # lone contexts are asked for by nobody else
        model = spark.createDataFrame([], _MODEL_DDL)
        for kind in range(1, order):
            model = model.unionByName(said(kind).where("what = 'shared'").select(*model.columns))
        scores = scratch(spark, "katz-scores")
        done = _finished(said(order - 1), model, orders, buckets)
        done.write.parquet(scores)
        for what in ("texts", "asks"):
            remove(spark, f"{weights[-1]}/what={what}")
        remove(spark, at)
        if model_path:
            # last, so that a model with this table is whole
            spark.createDataFrame([(order, buckets)], "order int, buckets long").write.parquet(f"{path}/about")
        else:
            remove(spark, path)
    return spark.read.schema(done.schema).parquet(scores)


def score_stored(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``score_texts`` for texts that teach nothing, from a stored model alone."""
    spark = docs.sparkSession
    about = spark.read.schema("order int, buckets long").parquet(f"{model_path}/about").first()

    def stored(table: str, orders: range, ddl: str) -> DataFrame:
        # each order's folder by its name: a model of one word has no weights
        out = spark.createDataFrame([], ddl)
        for n in orders:
            out = out.unionByName(spark.read.schema(ddl).parquet(f"{model_path}/{table}/order={n}").select(*out.columns))
        return out

    counts = stored("counts", range(1, about.order + 1), f"{_MODEL_DDL}, {_SUMS_DDL}")
    orders = _orders(counts, about.order)
    at = _blocks(docs, id_col, text_col, F.lit(True))
    blocks = spark.read.schema(_BLOCK_DDL).parquet(at)
    asked = blocks.mapInArrow(_ask(about.buckets, range(about.order)), _ASK_DDL).select("kind", "bucket", "block", "keys", F.lit(None).cast("binary").alias("value"))
    look_up = _look_up(from_counts, to_counts, "counts", _ANSWER_DDL)
    found = asked.unionByName(counts.select(*asked.columns)).groupBy("kind", "bucket").applyInPandas(look_up, _ANSWER_DDL)
    path = scratch(spark, "katz-scored")
    _scored(blocks, found, orders, path)
    weights = stored("weights", range(2, about.order + 1), f"{_CUT_DDL}, what string")
    own = _slots(weights.where("what = 'own'"), about.buckets).select("kind", "bucket", "block", "keys", "value")
    model = own.unionByName(weights.where("what = 'shared'").select(*own.columns))
    return _finished(spark.read.schema(f"{_SCORED_DDL.removeprefix('what string, ')}, order int, what string").parquet(path), model, orders, about.buckets)
