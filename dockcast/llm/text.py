"""Helpers shared by the text operators: Arrow plumbing, word spans, 64-bit hashes.

Word hashes are computed for a whole text at once: a polynomial over a random
byte table (mod 2**64) gives every span's hash as a difference of prefix sums,
and a finaliser mixes the bits.  Texts are UTF-8 bytes throughout, so
``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.session import checkpoint_dir

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)

# ASCII white space: [\x20\x09-\x0D] separates words
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False
# word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: 0-9, a-z, non-ASCII
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
# the same class as a bytes.translate table: every other byte becomes a blank
ALNUM_TABLE = bytes(i if ALNUM_WORD[i] else 0x20 for i in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> None:
    global _POW, _IPOW
    if len(_POW) < n:
        n = max(n, 2 * len(_POW), 1 << 16)
        for name, b in (("_POW", _BASE), ("_IPOW", _INV)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            globals()[name] = np.cumprod(p)


def spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of word bytes."""
    # a table of 256 bools is a translation table too
    inside = np.frombuffer(b"\0" + buf.tobytes().translate(is_word.tobytes()) + b"\0", np.uint8)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    n = len(buf)
    _powers(n + 1)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[buf] * _POW[:n], out=h[1:])
    return mix((h[ends] - h[starts]) * _IPOW[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hash of every white-space word of ``text`` with A-Z lower-cased; null is empty."""
    if not text:
        return np.empty(0, np.uint64)
    buf = np.frombuffer(text.lower(), np.uint8)
    return span_hashes(buf, *spans(buf, SPACE_WORD))


def sorted_distinct(a: np.ndarray) -> np.ndarray:
    """``np.unique``, which is slower on 64-bit hashes."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words: the whole
    sequence as one; no words: empty."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(k, len(w))
    h = np.zeros(len(w) - width + 1, np.uint64)
    for j in range(width):
        h *= np.uint64(_BASE)
        h += w[j : j + len(h)]
    # a short sequence must not equal a longer shingle that hashes alike
    h += np.uint64(width)
    return sorted_distinct(mix(h))


def binary(batch: pa.RecordBatch, name: str) -> list:
    """A string column as UTF-8 bytes (no decoding)."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column ``name`` holds about ``most`` bytes each."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * most / max(1, b.column(name).nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches to Python are cut by bytes as well as rows, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def kept_rows(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[bytes | None], bool]]) -> DataFrame:
    """The rows of ``docs`` whose text is kept, columns unchanged.  ``judge`` makes, in
    the worker, the function that says so."""
    small_batches(docs.sparkSession)

    def run(batches):
        keep = judge()
        for b in pieces(batches, text_col):
            texts = b.column(text_col).cast(pa.string()).cast(pa.binary()).to_pylist()
            rows = b.filter(pa.array([keep(t) for t in texts], pa.bool_()))
            if rows.num_rows:
                yield rows
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.mapInArrow(run, docs.schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of a partition sorted by the integer column ``key``: batches
    cut at group ends, each with the offsets of its groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        if held and held[0].column(key)[0].as_py() != k[0]:
            yield _joined(held), np.array([0, sum(x.num_rows for x in held)])
            held = []
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if not len(cuts):
            held.append(b)
            continue
        whole = _joined([*held, b.slice(0, cuts[-1])])
        yield whole, np.concatenate(([0], cuts + (whole.num_rows - cuts[-1]))) if held else np.concatenate(([0], cuts))
        held = [b.slice(cuts[-1])]
    if held:
        yield _joined(held), np.array([0, sum(x.num_rows for x in held)])


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def id_hash_mod(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


# inside of a character class: what parts words
SPACES = r"\x20\x09-\x0D"
NOT_ALNUM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def single_blanks(text: Column, parting: str) -> Column:
    """The words of a text between single blanks, JVM-side."""
    return F.trim(F.regexp_replace(text, f"[{parting}]+", " "))


def count_words(blanked: Column) -> Column:
    """Number of words in the result of ``single_blanks``.  (Extracting the words
    by a pattern would copy the text for each.)"""
    blanks = F.length(blanked) - F.length(F.replace(blanked, F.lit(" "), F.lit("")))
    return F.when(blanked == "", 0).otherwise(blanks + 1).cast("long")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: it cuts the
    lineage, and a lost executor costs a reread instead of a rerun."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A small table kept in the shared checkpoint folder until it is garbage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shipped(spark: SparkSession, value):
    """Broadcast a Python value whose size the caller has bounded."""
    return spark.sparkContext.broadcast(value)


def sized_broadcast(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """A broadcast hint for a table that is counted first; beyond the bound the
    plain shuffle join stays."""
    return F.broadcast(df) if df.count() <= most_rows else df


def hash_share(*cols: Column) -> Column:
    """A uniform double in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)
