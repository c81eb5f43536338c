"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

The n-grams are of words (one and two in a row, a repeated neighbour counted as
such) and of word shapes (letters, capitals, digits and signs with runs reduced),
hashed to a fixed number of weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockcast.llm.text import SPACE_WORD, binary, hash_share, kept_rows, mix, pieces, shipped, small_batches, span_hashes, spans

BITS = 18
SAMPLE_ROWS = 8000  # the training sample's bound
THRESHOLD = 0.7
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3

_K = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.arange(1, 5, dtype=np.uint64) * _K  # one for each kind of n-gram
# shape of a byte: a letter, a capital, a digit, any sign as it is
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their values; a bias slot is always there."""
    bias = np.zeros(1, np.int64), np.ones(1)
    if not text:
        return bias
    raw = np.frombuffer(text, np.uint8)
    starts, ends = spans(raw, SPACE_WORD)
    if not len(starts):
        return bias
    words = span_hashes(np.frombuffer(text.lower(), np.uint8), starts, ends)
    shape = _SHAPE[raw]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    at = np.concatenate(([0], np.cumsum(keep)))
    # a word starts a run, as white space stands before it
    shapes = span_hashes(shape[keep], at[starts], at[ends])
    slots, values = [bias[0]], [bias[1]]
    for salt, (x, same) in enumerate(((words, True), (shapes, False))):
        two = x[:-1] * _K + x[1:]
        if same:
            two = np.where(x[:-1] == x[1:], np.uint64(1), two)
        for n, grams in enumerate((x, two)):
            if not len(grams):
                continue
            slot = 1 + (mix(grams + _SALT[2 * salt + n]) % np.uint64((1 << BITS) - 1)).astype(np.int64)
            slot, count = np.unique(slot, return_counts=True)
            v = np.sqrt(count / len(grams))  # unit length for each kind of n-gram
            slots.append(slot)
            values.append(v)
    return np.concatenate(slots), np.concatenate(values)


class Ftrl:
    """FTRL-proximal for logistic loss; weights are derived from z and n."""

    def __init__(self):
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[i]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        # a slot may occur twice, as kinds of n-grams share the table
        np.add.at(self.z, i, g - step * w)
        np.add.at(self.n, i, g * g)


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train: Column | None = None
) -> np.ndarray:
    """The weights (a fixed number of them), learned from labelled rows.

    ``train`` is a condition on the labels' id column that selects the rows to
    learn from.  Rows with a null id, label or text teach nothing; an id with
    several labels teaches each.  The sample is taken by a hash of the id and
    holds at most SAMPLE_ROWS rows, half of each label where there are enough of
    both; the bias then restores the labels' shares.  One task fits it.  No
    labelled rows: all weights 0, so that every score is 0.5.
    """
    lab = labels.where(train) if train is not None else labels
    lab = lab.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).where("__id is not null and y in (0, 1)")
    sizes = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    if not sizes:
        return np.zeros(1 << BITS)
    share = hash_share(F.lit(29), F.col("__id"))
    # 0.8: a hash sample may exceed its expectation; the limit is the hard bound
    rate = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, 0.8 * SAMPLE_ROWS / 2 / n))])
    lab = lab.where(share < rate[F.col("y")]).orderBy(share, "y").limit(SAMPLE_ROWS)
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # at most SAMPLE_ROWS rows on the broadcast side
    rows = text.join(F.broadcast(lab), "__id").orderBy(hash_share(F.lit(31), F.col("__id")), "y", "text").limit(2 * SAMPLE_ROWS)

    def learn(parts):
        seen = [(*features(t.encode()), y) for part in parts for t, y in zip(part["text"], part["y"])]
        model = Ftrl()
        for epoch in range(EPOCHS):
            order = np.random.default_rng(epoch).permutation(len(seen))
            for j in order:
                model.learn(*seen[j])
        w = model.weights(np.arange(1 << BITS))
        # the sample holds both labels alike; the bias restores their shares
        got = [sum(s[2] == y for s in seen) for y in (0, 1)]
        if all(got):
            w[0] += np.log(sizes[1] / sizes[0] * got[0] / got[1])
        at = np.flatnonzero(w)
        yield pd.DataFrame({"slot": at, "w": w[at]})

    w = np.zeros(1 << BITS)
    for r in rows.select("text", "y").coalesce(1).mapInPandas(learn, "slot long, w double").collect():
        w[r.slot] = r.w
    return w


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1) and predicted (score >= 0.7).

    Null and empty texts have the bias only and are scored too.  Only the id and
    text columns are read; repeated rows each get a row.
    """
    sent = shipped(docs.sparkSession, weights.astype(np.float64))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        w = sent.value
        for b in pieces(batches, "text"):
            s = np.array([score_text(t, w) for t in binary(b, "text")])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], schema=out
            )

    small_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, score double, predicted int")


def score_text(text: bytes | None, w: np.ndarray) -> float:
    i, x = features(text)
    return float(1 / (1 + np.exp(-np.clip(w[i] @ x, -35, 35))))


def keep_good(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted 0; columns unchanged.  Null and
    empty texts are judged by the bias; an empty table stays empty."""
    sent = shipped(docs.sparkSession, weights.astype(np.float64))
    return kept_rows(docs, text_col, lambda: lambda t: score_text(t, sent.value) >= THRESHOLD)
