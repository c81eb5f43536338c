"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (1 to 3, A-Z lower-cased, runs of other
ASCII bytes one blank), log-scaled, weighted by inverse document frequency and
normalised.  Each language has a few centroids from spherical k-means over a
bounded sample; a text gets the language of the centroid with the largest cosine
and is marked ``rejected`` beyond that centroid's radius.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dockcast.llm.text import binary, hash_share, pieces, shipped, small_batches, written

DIMS = 1 << 12
CENTROIDS = 3  # for each language
SAMPLE_PER_LANG = 400  # rows; the training sample's bound is this times the languages
UNKNOWN = "und"

# a-z and non-ASCII bytes stay, A-Z become a-z, the rest is a blank
_TABLE = np.full(256, 0x20, np.uint8)
_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE[0x80:] = np.arange(0x80, 0x100)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    buf = _TABLE[np.frombuffer(text, np.uint8)]
    if ((buf >= 0x61) & (buf <= 0x7A)).any():
        return True
    return bool((buf >= 0x80).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams."""
    b = _TABLE[np.frombuffer(b" " + text + b" ", np.uint8)]
    blank = b == 0x20
    b = b[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    out = np.zeros(DIMS, np.int64)
    gram = np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        gram = (gram[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        slot = ((gram + np.uint32(n << 28)) * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(slot, minlength=DIMS)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; the first centres are spread by farthest-first choice."""
    centres = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        far = (x @ np.array(centres).T).max(axis=1).argmin()
        centres.append(x[far])
    c = np.array(centres)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train: Column | None = None) -> dict:
    """The model: langs, centroids, idf, radius.

    ``train`` selects the rows to learn from; rows with a null language, or no
    letter, teach nothing.  The sample is taken by a hash of the id, at a rate
    for each language, and is at most SAMPLE_PER_LANG rows of each; a language's
    centroids are fitted by a task of its own.  The model holds some 100 kB for
    each language, which is what reaches the driver.  No such rows: an empty model.
    """
    rows = docs.where(train) if train is not None else docs
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return {"langs": []}
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 0.8 * SAMPLE_PER_LANG / r["count"])])
    # 0.8: a hash sample may exceed its expectation; the limit for each language is the hard bound
    share = hash_share(F.lit(11), F.coalesce(F.col("id").cast("string"), F.lit("")))
    sample = rows.where("text is not null").withColumn("share", share).where(F.col("share") < rate[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("share", "text"))
    sample = sample.withColumn("place", place).where(F.col("place") <= SAMPLE_PER_LANG).select("lang", "place", "text")
    grams = written(sample.mapInArrow(_counted, "lang string, place int, slots binary"), "langid-sample")

    seen = grams.mapInArrow(_seen, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    found = {r.slot: r.n for r in seen}
    texts = found.pop(-1, 0)
    if not texts:
        return {"langs": []}
    df = np.array([found.get(i, 0) for i in range(DIMS)])
    idf = np.log((1 + texts) / (1 + df)) + 1

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        mine = vectors(np.array([_slots(x) for x in part["slots"]]), idf)
        c = cluster(mine, CENTROIDS)
        near = mine @ c.T
        own = near.argmax(axis=1)
        # half of the least usual cosine of the centroid's own texts
        radius = [0.5 * float(np.quantile(near[own == j, j], 0.01)) if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": part["lang"].iloc[0], "number": range(len(c)), "vec": [x.astype("<f8").tobytes() for x in c], "radius": radius})

    model = grams.groupBy("lang").applyInPandas(learn, "lang string, number int, vec binary, radius double").collect()
    named = sorted(model, key=lambda r: (r.lang, r.number))
    return {
        "langs": [r.lang for r in named],
        "centroids": np.array([np.frombuffer(r.vec, "<f8") for r in named]),
        "radius": np.array([r.radius for r in named]),
        "idf": idf,
    }


def _slots(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def _counted(batches):
    """The gram counts of the sampled texts that hold a letter."""
    schema = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("slots", pa.binary())])
    for b in batches:
        out = [(lang, place, ngram_counts(t).astype("<u4").tobytes()) for lang, place, t in zip(*(b.column(c).to_pylist() for c in ("lang", "place")), binary(b, "text")) if has_letter(t)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _seen(batches):
    """How many texts hold each slot; slot -1: how many there are."""
    n, texts = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for x in b.column("slots").to_pylist():
            n += _slots(x) > 0
            texts += 1
    yield pa.RecordBatch.from_arrays([pa.array([-1, *range(DIMS)], pa.int32()), pa.array([texts, *n.tolist()], pa.int64())], names=["slot", "n"])


def identify(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, rejected.

    ``score`` is the cosine to the nearest centroid.  Null texts, texts without a
    letter and every text under an empty model get ``und``, score 0, rejected.
    Ties go to the language that sorts first.  Only id and text are read.
    """
    sent = shipped(docs.sparkSession, model)
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        m = sent.value
        for b in pieces(batches, "text"):
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), binary(b, "text")):
                if not m["langs"] or not has_letter(t):
                    rows.append((i, UNKNOWN, 0.0, True))
                    continue
                cos = m["centroids"] @ vectors(ngram_counts(t), m["idf"])
                j = int(cos.argmax())
                rows.append((i, m["langs"][j], float(min(max(cos[j], 0.0), 1.0)), bool(cos[j] < m["radius"][j])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    small_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
