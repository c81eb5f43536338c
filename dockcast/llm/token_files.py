"""Token ids in bit-packed blocks, with random access.

Ids are stored in the minimum number of bits for the vocabulary, little-endian,
in blocks of whole documents.  A block is one row of a Parquet table: its shard,
its number, the documents with their first id and the packed payload, so every
block can be unpacked on its own with numpy.  Spark's committer makes the write
atomic on any file system.  Documents are dealt to shards by ranges of the id (and of
the text's beginning, for rows that share an id), so blocks in (shard, block) order
hold ascending ids; offsets in the file count from the shard's start and become global
with one sum per shard.  There are at most MAX_SHARDS of them, which bounds that table;
readers get it by broadcast and no payload is ever shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.llm.text import binary, pieces, small_batches

BLOCK_IDS = 1 << 18  # a block is closed once it holds so many ids
SHARD_BYTES = 16 << 20  # of text for each shard; more where MAX_SHARDS would not do
MAX_SHARDS = 1 << 16
CACHE_WORDS = 600_000  # distinct words whose ids a worker remembers
# signs that are tokens of their own after a letter, to the end of a word
_SIGNS = rb'!"#$%&()*+,-./:;=>?@[\]^_`{|}~'
# letters: a-z and, in two bytes, those of Latin-1; signs are looked for first, as few bytes are
_TAIL = re.compile(rb"([%s](?:(?<=[a-z].)|(?<=\xC3[\x80-\x96\x98-\xB6\xB8-\xBF].))[%s]*)(?!\S)" % (re.escape(_SIGNS), re.escape(_SIGNS)))
END_ID = 1

_BLOCK = pa.schema(
    [
        ("shard", pa.int64()),
        ("block", pa.int64()),
        ("first", pa.int64()),
        ("n_ids", pa.int64()),
        ("bits", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
BLOCK_DDL = (
    "shard long, block long, first long, n_ids long, bits int, doc_ids array<long>, lengths array<long>, payload binary"
)


def bits_for(vocab: int) -> int:
    """Minimum bits for ids 0 .. vocab - 1."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, little-endian, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    plane = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(plane.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """``n`` ids from position ``start`` of a payload, without reading the rest."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    first = start * bits
    raw = np.frombuffer(payload, np.uint8)[first // 8 : -(-(first + n * bits) // 8)]
    plane = np.unpackbits(raw, bitorder="little")[first % 8 :][: n * bits].reshape(n, bits)
    return (plane.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Encodes texts word by word and remembers the ids of frequent words.

    The tokenizer drops white space between words, so the ids of a text are those
    of its words in turn.  A-Z are lower-cased first, as the tokenizer does.
    Texts that may hold a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size()
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(reversed(special.items()))
        # the word-wise way needs a tokenizer that drops white space and case
        a, b = (self.tok.encode(x, add_special_tokens=False).ids for x in ("ab cd", "\tAB \n cD "))
        c = [i for x in ("ab", "cd") for i in self.tok.encode(x, add_special_tokens=False).ids]
        self.wordwise = a == b == c
        for sign in [*map(chr, _SIGNS), _SIGNS.decode()]:
            for w in ("ab", "\xe9"):
                self.wordwise &= self._ids(w + sign) == self._ids(w) + self._ids(sign)
        self.is_end = np.zeros(self.vocab, bool)
        self.is_end[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}  # ids as little-endian 32-bit integers
        self.most: int | None = None  # words to remember; CACHE_WORDS by default

    def encode_all(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        if not self.wordwise:
            for t in texts:
                yield self._whole(t)
            return
        lists = [self._parts(t) if t and b"<|" not in t else None for t in texts]
        known = self.known
        new = list(set().union(*(ws for ws in lists if ws)).difference(known))
        # a full memory holds the words seen first, among them the frequent ones; it
        # knows the others for these texts alone
        most = CACHE_WORDS if self.most is None else self.most
        passing = new[max(0, most - len(known)) :]
        known.update(self._encode_words(new))
        try:
            for t, ws in zip(texts, lists):
                if ws is None:
                    yield self._whole(t)
                else:
                    yield np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4")
        finally:
            for w in passing:
                del known[w]

    @staticmethod
    def _parts(text: bytes) -> list[bytes]:
        """Words, with the signs after their last letter as words of their own: fewer
        distinct ones to encode and to remember."""
        return _TAIL.sub(rb" \1", text.lower()).split()

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of many words from few calls.  A word of letters is one piece, whose
        last token is a word end; other words are parted by a special token."""
        plain, other = [], []
        for w in words:
            x = w.decode()
            (plain if x.isalpha() and x == x.lower() else other).append((w, x))
        out = {}
        for part, join, ends in ((plain, " ", True), (other, self.mark, False)):
            for i in range(0, len(part), 20_000):
                got = part[i : i + 20_000]
                ids = np.array(self._ids(join.join(x for _, x in got)), "<u4")
                if ends:
                    stop = 4 * (np.flatnonzero(self.is_end[ids]) + 1)
                    start = np.concatenate(([0], stop[:-1]))
                else:
                    at = 4 * np.flatnonzero(ids == self.mark_id)
                    start, stop = np.concatenate(([0], at + 4)), np.append(at, 4 * len(ids))
                if len(stop) != len(got):  # not as foreseen: word by word
                    out.update((w, self._whole(w).astype("<u4").tobytes()) for w, _ in got)
                    continue
                data = ids.tobytes()
                out.update((w, data[s:e]) for (w, _), s, e in zip(got, start.tolist(), stop.tolist()))
        return out

    def _whole(self, t: bytes | None) -> np.ndarray:
        return np.array(self._ids(t.decode()) if t else [], np.uint32)

    def _ids(self, text: str) -> list[int]:
        # without offsets, which nothing reads
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    cache_words: int | None = None, piece_bytes: int = 8 << 20,
) -> None:
    """Write the token ids of all documents, each followed by ``end_id``.

    Documents come in ascending id; null ids come first, rows that share an id in
    the order of their texts.  Null texts count as empty: the end id alone.  An
    empty table writes no block.  Other columns are ignored.  ``cache_words`` bounds the
    words whose ids a worker remembers and ``piece_bytes`` the text whose words it holds
    at once, which changes memory and time alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, round(size / SHARD_BYTES)))
    # null ids come first; the beginning of a text orders as the text does
    dealt = rows.repartitionByRange(shards, "id", F.left("text", F.lit(32))).sortWithinPartitions("id", "text")
    rows = dealt.select(F.spark_partition_id().cast("long").alias("shard"), "id", "text")
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer_path)
        enc.most = cache_words
        bits = bits_for(max(enc.vocab, end_id + 1))
        end = np.array([end_id], np.uint32)
        shard, block, first, ids, doc_ids, lengths, held = None, 0, 0, [], [], [], 0

        def close():
            nonlocal block, first, ids, doc_ids, lengths, held
            if doc_ids:
                row = (shard, block, first, held, bits, doc_ids, lengths, pack(np.concatenate(ids), bits))
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _BLOCK)], schema=_BLOCK)
            block, first, ids, doc_ids, lengths, held = block + 1, first + held, [], [], [], 0

        for b in pieces(batches, "text", piece_bytes):
            for s, i, x in zip(b.column("shard").to_pylist(), b.column("id").to_pylist(), enc.encode_all(binary(b, "text"))):
                if s != shard:
                    yield from close()
                    shard, block, first = s, 0, 0
                ids += (x, end)
                doc_ids.append(i)
                lengths.append(len(x) + 1)
                held += len(x) + 1
                if held >= BLOCK_IDS:
                    yield from close()
        yield from close()
        pa.default_memory_pool().release_unused()  # the worker lives on

    # packed ids hold no repeats, but frequent ones: a codec that counts bytes makes them smaller
    rows.mapInArrow(run, BLOCK_DDL).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: the number of ids before each in the whole file."""
    blocks = spark.read.schema(BLOCK_DDL).parquet(path)
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # MAX_SHARDS rows at most
    ends = np.cumsum([r.n for r in sums], dtype=np.int64).tolist()
    index = spark.createDataFrame([(r.shard, e - r.n) for r, e in zip(sums, ends)], "at long, base long")
    return blocks.join(F.broadcast(index), F.col("shard") == F.col("at")).withColumn("start", F.col("base") + F.col("first")).drop("at")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the payloads;
    no rows where no block was written."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                start, n, bits, docs, lengths, payload = (b.column(c)[r].as_py() for c in ("start", "n_ids", "bits", "doc_ids", "lengths", "payload"))
                ids = unpack(payload, bits, 0, n).astype("<u4")
                ends = np.cumsum(lengths)
                at = ends - lengths
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(at, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], schema=out)

    cols = read_blocks(spark, path).select("start", "n_ids", "bits", "doc_ids", "lengths", "payload")
    return cols.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Ids [start, start + n) of the whole file; reads only the blocks that hold them.
    What lies beyond the last id is left out."""
    hit = read_blocks(spark, path).where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start))
    parts = []
    for r in hit.orderBy("start").select("start", "n_ids", "bits", "payload").collect():
        a, z = max(start, r.start), min(start + n, r.start + r.n_ids)
        parts.append(unpack(bytes(r.payload), r.bits, a - r.start, z - a))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)
