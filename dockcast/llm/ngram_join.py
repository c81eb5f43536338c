"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence.

Rows of the incidence matrix are documents (equal sets are one row), columns are
the hashed five-word shingles.  Two rows with Jaccard similarity 3/4 share at least
3/4 of the larger set, so in any common order of the columns they share one of
their first ``n - ceil(3n/4) + 1``.  Rare columns come first: a fixed table of
hashed column counts over all documents gives the order, and any order is right.

1. Blocks of rows send their first columns to column blocks; inside each block a
   column links its rows to the smallest one, never all rows with each other.
2. Linked rows are compared: sizes and counts in 128 hash bins, then in bins as
   many as the set asks for, bound the overlap from above and discard most pairs;
   the rest is counted on the texts.
3. Columns whose rows are not yet one component are gone through in tiles: only
   rows of different components are compared, by the same bounds.  Few pairs left
   are counted as in 2; columns with many are joined to groups, and a group's
   incidence matrix is multiplied out tile by tile.
4. Components of all links found give the result.

``jaccard_degrees`` counts every link of every document: step 3 goes through all
columns of three or more rows, and rows of one component are compared as well.  A group
of many near copies is never listed by pairs: its tiles give each row's number of links
and a forest.  ``jaccard_links`` lists the links themselves.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.llm.blocks import from_planes, keys_from_bytes, keys_to_bytes, slices, to_planes
from dockcast.llm.graph import components
from dockcast.llm.text import binary, pieces, scratch, shingle_set, shipped, small_batches, sorted_groups
from dockcast.llm.vector_dedup import forest

WIDTH = 5
BINS = 128
COUNTERS = 1 << 18  # of the column count table, whatever the corpus
BLOCK_ENTRIES = 1 << 19  # first columns of one block of rows
BUCKET_ENTRIES = 1 << 20
TILE = 512
TILE_ENTRIES = 1 << 20  # shingles of the rows of a part, where texts are multiplied out
MASK_BITS = 1 << 26  # of the table of ids whose texts are asked for, whatever the corpus

_INFO_DDL = "doc_id long, n_shingles long, node long, bins binary, slot int, n long"
_ASK_DDL = "kind int, bucket long, keys binary, row binary, nodes binary, other binary"
_EDGE_DDL = "col long, a long, b long"
_LINK_DDL = "a long, b long, overlap long"
# in place of a component where all links count: a tile of two parts compares rows of
# one part with those of the other, a tile of one part all its rows
_PART_SQL = "if(mine = other, node, cast(mine as bigint))"


def node_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), 7) - (1 << 63)


def bins_of(s: np.ndarray) -> bytes:
    """How many elements fall into each bin; 255 stands for so many or more."""
    return np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def prefix(n: int) -> int:
    """First columns that a row must show: any partner shares one of them."""
    return n - -(-3 * n // 4) + 1


def linked(inter, n, m):
    """Jaccard similarity of at least 3/4, in integers."""
    return 100 * inter >= 75 * (n + m - inter)


def may_link(n, bins, m, others) -> np.ndarray:
    """False where sizes or bin counts rule a link out.  ``bins`` (BINS) against
    ``others`` (k x BINS)."""
    size = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
    most = np.minimum(bins, others).sum(axis=-1, dtype=np.int64)
    full = (bins == 255).any(axis=-1) | (others == 255).any(axis=-1)
    return size & (full | linked(most, n, m))


def fine_bins(s: np.ndarray) -> np.ndarray:
    """As ``bins_of``, with one or two elements a bin on average: the bins of a
    smaller set are sums of whole runs of a larger set's bins."""
    k = max(7, (len(s) // 2).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8)


def may_link_finely(x: np.ndarray, y: np.ndarray) -> bool:
    """False where ``fine_bins`` of two sets rule a link out."""
    if (x == 255).any() or (y == 255).any():
        return True
    k = min(len(x), len(y))
    x, y = (v.reshape(k, -1).sum(axis=1, dtype=np.int64) for v in (x, y))
    return bool(linked(np.minimum(x, y).sum(), x.sum(), y.sum()))


def _info(batches):
    """A row for each document, then the task's column counts (rows with a slot)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bins", pa.binary()), ("slot", pa.int32()), ("n", pa.int64())])
    total = np.zeros(COUNTERS, np.int64)

    def made(cols, rows):
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(rows, f.type) for f in schema], schema=schema)

    for b in pieces(batches, "text"):
        sizes, nodes, bins, slots = [], [], [], []
        for t in binary(b, "text"):
            s = shingle_set(t, WIDTH)
            sizes.append(len(s))
            nodes.append(node_of(s) if len(s) else None)
            bins.append(bins_of(s) if len(s) else None)
            slots.append((s % np.uint64(COUNTERS)).astype(np.int64))
        total += np.bincount(np.concatenate(slots), minlength=COUNTERS)
        yield made({"doc_id": b.column("doc_id"), "n_shingles": sizes, "node": nodes, "bins": bins}, b.num_rows)
    at = np.flatnonzero(total)
    yield made({"slot": at.astype(np.int32), "n": total[at]}, len(at))
    pa.default_memory_pool().release_unused()  # the worker lives on


def _first_columns(sent, buckets: int):
    """Blocks of rows -> entries for the column blocks, and links inside the block."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64())] + [(c, pa.binary()) for c in ("keys", "row", "nodes", "other")])

    def run(batches):
        rank = sent.value
        parts, nodes, seen, held = [], [], set(), 0

        def close():
            nonlocal parts, nodes, seen, held
            if nodes:
                names = np.array(nodes, np.int64)
                keys = np.concatenate(parts)
                row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                by_name = np.argsort(names)
                place = np.empty_like(by_name)
                place[by_name] = np.arange(len(names))
                names, row = names[by_name], place[row]
                order = np.lexsort((row, keys))
                keys, row = keys[order], row[order]
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                low = row[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]  # smallest row of the column
                out = []
                if not new.all():
                    # links inside the block need no column block of their own; the bucket
                    # follows from the rows, so that a task run again sends the same rows there
                    bucket = int(names[0]) % buckets
                    out.append((1, bucket, to_planes(keys[~new]), to_planes(row[~new].astype(np.uint32)), to_planes(names), to_planes(low[~new].astype(np.uint32))))
                keys, row = keys[new], row[new]
                for b, i, j in slices(keys, buckets):
                    used, local = np.unique(row[i:j], return_inverse=True)
                    out.append((0, b, keys_to_bytes(keys[i:j]), to_planes(local.astype(np.uint32)), to_planes(names[used]), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            parts, nodes, seen, held = [], [], set(), 0

        for b in pieces(batches, "text"):
            for t in binary(b, "text"):
                s = shingle_set(t, WIDTH)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                p = prefix(len(s))
                # rarest first, then by hash; the set is sorted by hash already
                parts.append(s[np.argsort(rank[(s % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")[:p]])
                nodes.append(node)
                held += p
                if held >= BLOCK_ENTRIES:
                    yield from close()
        yield from close()

    return run


def _column_links(group: pd.DataFrame) -> pd.DataFrame:
    """Each column's rows linked to the smallest one."""
    out = []
    cols = (group[c] for c in ("keys", "row", "nodes", "other"))
    rows = [(k, from_planes(r, np.uint32), from_planes(n, np.int64), o) for k, r, n, o in zip(*cols)]
    if group["kind"].iloc[0] == 1:
        for keys, row, nodes, other in rows:
            out.append((from_planes(keys, np.uint64).view(np.int64), nodes[from_planes(other, np.uint32)], nodes[row]))
    else:
        keys = np.concatenate([keys_from_bytes(k) for k, *_ in rows])
        nodes = np.concatenate([n[r] for _, r, n, _ in rows])
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        low = nodes[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        other = ~new & (low != nodes)
        out.append((keys[other].view(np.int64), low[other], nodes[other]))
    cols = [np.concatenate(x) for x in zip(*out)]
    return pd.DataFrame({"col": cols[0], "a": cols[1], "b": cols[2]})


def _saved(df: DataFrame, name: str, ddl: str | None = None) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(ddl or df.schema).parquet(path)


def _bounded(batches):
    """Pairs whose sizes and bins allow a link."""
    for b in batches:
        if not b.num_rows:
            continue
        n, m = b.column("na").to_numpy(), b.column("nb").to_numpy()
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("xa", "xb"))
        ok = may_link(n, x, m, y)
        yield b.filter(pa.array(ok)).select(["a", "b"])


def _bounded_finely(batches):
    """Pairs whose fine bins allow a link; long sets fill all the coarse bins."""
    for b in pieces(batches, "xb"):
        ok, last, x = [], None, None
        for a, xa, xb in zip(*(b.column(c).to_pylist() for c in ("a", "xa", "xb"))):
            if a != last:
                last, x = a, _unpacked_bins(xa)
            ok.append(may_link_finely(x, _unpacked_bins(xb)))
        yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _count_overlap(batches):
    """Pairs that link, counted on their texts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])
    for b in pieces(batches, "tb"):
        out, last, s = [], None, None
        for a, c, ta, tb in zip(*(b.column(x).to_pylist() for x in ("a", "b", "ta", "tb"))):
            if a != last:
                last, s = a, _unpacked_set(ta)
            r = _unpacked_set(tb)
            inter = len(np.intersect1d(s, r, assume_unique=True))
            if linked(inter, len(s), len(r)):
                out.append((a, c, inter))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], schema=schema)


def _unpacked_set(packed: bytes) -> np.ndarray:
    return shingle_set(zstandard.decompress(packed), WIDTH)


def _unpacked_bins(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.uint8)


def _packed(sent, what: str):
    """Documents whose id the mask names -> (node, compressed text or fine bins)."""
    schema = pa.schema([("node", pa.int64()), ("data", pa.binary())])

    def run(batches):
        mask, pack = sent.value, zstandard.ZstdCompressor(level=3)
        for b in batches:
            slot = b.column("slot").to_numpy()
            b = b.filter(pa.array((mask[slot >> 6] >> (slot & 63)) & 1 == 1))
            for part in pieces([b], "text"):
                nodes, data = [], []
                for t in binary(part, "text"):
                    s = shingle_set(t, WIDTH)
                    if len(s):
                        nodes.append(node_of(s))
                        data.append(pack.compress(t if what == "text" else fine_bins(s).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], schema=schema)

    return run


def _fetched(what: str, nodes: DataFrame, reps: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """(node, data) of the named sets: their texts or fine bins, compressed.  A bit
    mask of fixed size over hashed ids picks the documents, so the others are never
    shuffled.  Rows beyond the named sets (ids that share a bit, ids with several
    texts) match no node that the readers join, or repeat one."""
    ids = nodes.join(reps.select("node", "rep"), "node")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MASK_BITS).cast("long"))
    bits = ids.select(slot("rep").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    bits = bits.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toPandas()
    mask = np.zeros(MASK_BITS // 64, np.int64)
    mask[bits["word"].to_numpy(dtype=np.int64)] = bits["bits"].to_numpy(dtype=np.int64)
    picked = docs.select("text", slot("doc_id").alias("slot"))
    if not mask.any():
        picked = picked.limit(0)
    ddl = "node long, data binary"
    return _saved(picked.mapInArrow(_packed(shipped(docs.sparkSession, mask), what), ddl), name, ddl)


def _paired(pairs: DataFrame, data: DataFrame, col: str) -> DataFrame:
    """The pairs (a, b) with the data of both ends."""
    side = lambda x: data.select(F.col("node").alias(x), F.col("data").alias(f"{col}{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", f"{col}a", f"{col}b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that link, with their overlap."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"x{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    left = _saved(both.mapInArrow(_bounded, "a long, b long"), f"{name}-bounded")
    bins = _fetched("bins", _ends(left), reps, docs, f"{name}-bins")
    left = _paired(left, bins, "x").mapInArrow(_bounded_finely, "a long, b long").distinct()
    left = _saved(left, f"{name}-close")
    texts = _fetched("text", _ends(left), reps, docs, f"{name}-texts")
    return _saved(_paired(left, texts, "t").mapInArrow(_count_overlap, _LINK_DDL), f"{name}-links")


def _tile_pairs(batches):
    """Tiles of rows -> the pairs that may link, or the tile itself (b is null)
    where they are too many to be listed."""
    schema = pa.schema([("tile", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    for b, offsets in sorted_groups(batches, "tile"):
        tile, node, n, comp = (b.column(c).to_numpy() for c in ("tile", "node", "n", "comp"))
        bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
        for s, e in zip(offsets, offsets[1:]):
            a, z, held = [], [], 0
            for i in range(s, e - 1):
                hit = np.flatnonzero((comp[i + 1 : e] != comp[i]) & may_link(n[i], bins[i], n[i + 1 : e], bins[i + 1 : e])) + i + 1
                hit = hit[node[hit] != node[i]]
                if len(hit):
                    a.append(np.full(len(hit), node[i]))
                    z.append(node[hit])
                    held += len(hit)
                if held > 8 * (e - s):
                    break
            if held > 8 * (e - s):
                yield pa.RecordBatch.from_arrays([pa.array([tile[s]]), pa.array([None], pa.int64()), pa.array([None], pa.int64())], schema=schema)
            elif a:
                x, y = np.concatenate(a), np.concatenate(z)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tile[s])), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)


def _tile_product(sets: list[np.ndarray]):
    """Sizes, and a function that gives the overlaps of a row with all others: its
    product with the tile's columns, accumulated column by column."""
    sizes = np.array([len(s) for s in sets])
    cols, where = np.unique(np.concatenate(sets), return_inverse=True)
    row_of = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(where, kind="stable")
    starts = np.searchsorted(where[order], np.arange(len(cols) + 1))
    by_col = row_of[order]
    ends = np.cumsum(sizes)

    def overlaps(i: int) -> np.ndarray:
        mine = where[ends[i] - sizes[i] : ends[i]]
        return np.bincount(np.concatenate([by_col[starts[c] : starts[c + 1]] for c in mine]), minlength=len(sets))

    return sizes, overlaps


def tile_links(sets: list[np.ndarray], comp: list[int]) -> list[tuple[int, int]]:
    """Links between rows of a tile that join different components."""
    sizes, overlaps = _tile_product(sets)
    _, part = np.unique(np.asarray(comp), return_inverse=True)
    out = []
    for i in range(len(sets)):
        if (part == part[i]).all():
            break
        inter = overlaps(i)
        hit = np.flatnonzero(linked(inter, sizes[i], sizes) & (part != part[i]))
        for j in hit:
            if part[j] != part[i]:
                out.append((i, int(j)))
                part[part == part[j]] = part[i]
    return out


def _multiply(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for b, offsets in sorted_groups(batches, "tile"):
        node, comp = b.column("node").to_numpy(), b.column("comp").to_numpy()
        for s, e in zip(offsets, offsets[1:]):
            sets = [_unpacked_set(t) for t in b.column("data").slice(s, e - s).to_pylist()]
            got = tile_links(sets, list(comp[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array([node[s + i] for i, _ in got], pa.int64()), pa.array([node[s + j] for _, j in got], pa.int64())], schema=schema)


def _multiply_all(batches):
    """As ``_multiply``, with all links between rows of different ``comp`` and
    their overlaps."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])
    for b, offsets in sorted_groups(batches, "tile"):
        node, comp = b.column("node").to_numpy(), b.column("comp").to_numpy()
        for s, e in zip(offsets, offsets[1:]):
            sizes, overlaps = _tile_product([_unpacked_set(t) for t in b.column("data").slice(s, e - s).to_pylist()])
            for i in range(e - s - 1):
                inter = overlaps(i)
                hit = np.flatnonzero(linked(inter, sizes[i], sizes) & (comp[s:e] != comp[s + i]) & (node[s:e] != node[s + i]))
                hit = hit[hit > i]  # a set may come twice (texts of one id)
                other = node[s + hit]
                cols = [np.minimum(other, node[s + i]), np.maximum(other, node[s + i]), inter[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)


def _tile_degrees(batches):
    """Tiles -> each row's links inside of the tile, as numbers of documents (``size`` of
    a set), and the smallest row that links reach."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    for b, offsets in sorted_groups(batches, "tile"):
        for s, e in zip(offsets, offsets[1:]):
            # a set may come twice (texts of one id)
            node, first = np.unique(b.column("node").to_numpy()[s:e], return_index=True)
            part = b.slice(s, e - s).take(pa.array(first))
            comp, size = part.column("comp").to_numpy(), part.column("size").to_numpy()
            sizes, overlaps = _tile_product([_unpacked_set(t) for t in part.column("data").to_pylist()])
            link = np.array([linked(overlaps(i), sizes[i], sizes) & (comp != comp[i]) for i in range(len(node))])
            links = link @ size
            hit = links > 0
            columns = (node[hit], links[hit], node[forest(link)][hit])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)


def _labelled(nodes: DataFrame, col: str, comp: DataFrame, out: str) -> DataFrame:
    c = comp.select(F.col("id").alias("__id"), F.col("component").alias("__c"))
    return nodes.join(c, nodes[col] == c["__id"], "left").withColumn(out, F.coalesce("__c", col)).drop("__id", "__c")


def _open_tiles(edges: DataFrame, comp: DataFrame | None, reps: DataFrame) -> DataFrame:
    """Rows (tile, node, n, bins, comp) of columns that hold three or more
    rows of more than one component; of all with three or more rows, if no
    components are given."""
    rows = edges
    if comp is not None:
        pairs = edges.select("a", "b").distinct()
        apart = _labelled(_labelled(pairs, "a", comp, "ca"), "b", comp, "cb").where("ca <> cb").select("a", "b")
        some = edges.join(apart, ["a", "b"], "left_semi").select("col").distinct()
        rows = edges.join(some, "col", "left_semi")
    member = rows.select("col", F.explode(F.array("a", "b")).alias("node")).distinct()
    cols = member.groupBy("col").agg(
        F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("node").alias("low"), F.max("node").alias("high")
    )
    # two rows were compared already; columns with equal rows need one turn
    cols = cols.where("m > 2").groupBy("m", "sum", "low", "high").agg(F.min("col").alias("col"))
    cols = cols.select("col", F.ceil(F.col("m") / TILE).cast("int").alias("chunks"))
    member = member.join(cols, "col").join(reps, "node")
    member = _in_tiles(member, "col").withColumn("comp", F.expr(_PART_SQL)) if comp is None else _in_tiles(_labelled(member, "node", comp, "comp"), "col")
    return member.select("tile", "node", "n", "bins", "comp")


def _in_tiles(member: DataFrame, group: str) -> DataFrame:
    """Rows of each group dealt to ``chunks`` parts, and a copy for each tile, that
    is each pair of parts."""
    mine = F.pmod(F.xxhash64(F.lit(3), "node"), "chunks").cast("int")
    member = member.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return member.withColumn("tile", F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other")))


def _merged_tiles(tiles: DataFrame, reps: DataFrame, all_links: bool = False) -> DataFrame:
    """Columns that share rows as one group, so that its rows meet once instead of
    once for each column: rows (tile, node, comp)."""
    low = tiles.groupBy("tile").agg(F.min("node").alias("low"))
    star = tiles.join(low, "tile").select(F.col("low").alias("a"), F.col("node").alias("b"))
    rows = tiles.select("node").distinct() if all_links else tiles.select("node", "comp").distinct()
    member = _labelled(rows, "node", components(star), "group").join(reps.select("node", "n"), "node")
    parts = F.greatest(F.count("*") / TILE, F.sum("n") / TILE_ENTRIES)
    sizes = member.groupBy("group").agg(F.ceil(parts).cast("int").alias("chunks"))
    if all_links:
        return _in_tiles(member.join(sizes, "group"), "group").selectExpr("tile", "node", f"{_PART_SQL} AS comp", "group")
    return _in_tiles(member.join(sizes, "group"), "group").select("tile", "node", "comp")


def _column_ranks(spark: SparkSession, counts: DataFrame):
    """The table of column counts: its size is fixed, so it is broadcast."""
    counts = counts.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    rank = np.zeros(COUNTERS, np.int64)
    rank[counts["slot"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    return shipped(spark, rank)


class _Prepared(NamedTuple):
    info: DataFrame  # a row for each document
    named: DataFrame  # those that may link
    reps: DataFrame  # the distinct sets
    texts: DataFrame
    edges: DataFrame  # each column's rows, linked to the smallest one


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> _Prepared:
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _saved(texts.mapInArrow(_info, _INFO_DDL), "join-rows", _INFO_DDL)
    info = rows.where("slot is null").drop("slot", "n")
    named = info.where("doc_id is not null and node is not null")
    reps = named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bins").alias("bins"))
    reps = _saved(reps, "join-reps")
    texts = texts.where("doc_id is not null and text is not null")

    ranks = _column_ranks(spark, rows.where("slot is not null").select("slot", "n"))
    entries = info.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, -(-entries // 4 // BUCKET_ENTRIES))
    asked = texts.mapInArrow(_first_columns(ranks, buckets), _ASK_DDL)
    edges = _saved(asked.groupBy("kind", "bucket").applyInPandas(_column_links, _EDGE_DDL), "join-columns", _EDGE_DDL)
    return _Prepared(info, named, reps, texts, edges)


def _listed(p: _Prepared, all_links: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b, overlap) of the pairs that could be listed, from the columns and from
    their tiles, and the merged tiles of the rows with more pairs than that."""
    links = _verified(p.edges.select("a", "b").distinct(), p.reps, p.texts, "join")
    tiles = _saved(_open_tiles(p.edges, None if all_links else components(links), p.reps), "join-tiles")
    bounded = tiles.repartition("tile").sortWithinPartitions("tile")
    bounded = _saved(bounded.mapInArrow(_tile_pairs, "tile long, a long, b long"), "join-tile-pairs")
    more = bounded.where("a is not null").select("a", "b").distinct()
    if all_links:  # without those that were compared above
        more = more.join(p.edges.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), ["a", "b"], "left_anti")
    more = _verified(more, p.reps, p.texts, "join-more")
    full = tiles.join(bounded.where("a is null").select("tile"), "tile", "left_semi").select("tile", "node", "comp")
    full = _saved(full, "join-full-tiles")
    return links, more, _saved(_merged_tiles(full, p.reps, all_links), "join-merged-tiles")


def _with_texts(p: _Prepared, merged: DataFrame) -> DataFrame:
    """Merged tiles with their texts, each tile in one partition."""
    full = merged.join(_fetched("text", merged.select("node").distinct(), p.reps, p.texts, "join-full-texts"), "node")
    return full.repartition("tile").sortWithinPartitions("tile")


def _links(p: _Prepared, all_links: bool) -> DataFrame:
    """Links (a, b) of sets: all of them with their overlaps, or as many as give
    the components."""
    links, more, merged = _listed(p, all_links)
    full = _with_texts(p, merged.select("tile", "node", "comp"))
    if all_links:
        multiplied = _saved(full.mapInArrow(_multiply_all, _LINK_DDL), "join-products")
        ends = ["least(a, b) AS a", "greatest(a, b) AS b", "overlap"]
        return _saved(links.selectExpr(*ends).unionByName(more.selectExpr(*ends)).unionByName(multiplied).distinct(), "join-all-links")
    multiplied = _saved(full.mapInArrow(_multiply, "a long, b long"), "join-products")
    return links.select("a", "b").unionByName(more.select("a", "b")).unionByName(multiplied)


def _document_components(p: _Prepared, found: DataFrame) -> DataFrame:
    """From sets to documents: smallest ids stand for sets, copies hang on them."""
    name = lambda c: p.reps.select(F.col("node").alias(c), F.col("rep").alias(f"r{c}"))
    found = found.join(name("a"), "a").join(name("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    copies = p.named.join(p.reps.select("node", "rep"), "node").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return components(found.unionByName(copies)).select(F.col("id").alias("doc_id"), "component")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null texts and texts without words have an empty set and link with nothing.
    Rows with a null id have no component and link with nothing.  Rows that share
    an id are one document in several pieces: each keeps its own n_shingles, and
    all have one component.  Only the id and text columns are read.  Empty table:
    no rows.
    """
    p = _prepared(docs, id_col, text_col)
    comp = _document_components(p, _links(p, all_links=False))
    out = p.info.select("doc_id", "n_shingles").join(comp, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_degrees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, set_id, n_links, component_id.

    As the members of ``jaccard_links``, without a row for each link: ``n_links`` are
    summed in the tiles of large groups, and over listed pairs elsewhere.
    """
    p = _prepared(docs, id_col, text_col)
    links, more, merged = _listed(p, all_links=True)
    sizes = _saved(p.named.groupBy("node").agg(F.count("*").alias("size")), "join-sizes")
    tiles = merged.select("tile", "node", "comp").join(sizes, "node")
    inside = _saved(_with_texts(p, tiles).mapInArrow(_tile_degrees, "node long, links long, root long"), "join-degrees")
    # pairs inside of a merged group were met in its tiles
    group = merged.select("node", "group").distinct()
    end = lambda x: group.select(F.col("node").alias(x), F.col("group").alias(f"g{x}"))
    pairs = links.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").unionByName(more.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")).distinct()
    pairs = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").where("ga IS NULL OR gb IS NULL OR ga <> gb")
    pairs = _saved(pairs.select("a", "b"), "join-outer-pairs")
    arcs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = arcs.join(sizes.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("size").alias("links"))
    others = outside.unionByName(inside.select("node", "links")).groupBy("node").agg(F.sum("links").alias("others"))
    found = pairs.unionByName(inside.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return _members(p, sizes, others, found)


def _members(p: _Prepared, sizes: DataFrame, others: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each document, from the links of its set with other sets."""
    number = sizes.join(others, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    rows = p.info.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    rows = rows.join(number, "node", "left").join(_document_components(p, found), "doc_id", "left")
    return rows.select(
        "doc_id", "n_shingles", F.col("node").alias("set_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def jaccard_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: pairs of different sets (a, b, overlap), each once with a < b, and
    the members of the sets, one row per input row: doc_id, n_shingles, set_id,
    n_links, component_id.

    ``n_links`` counts the other rows that link with the row, copies included.  Rows
    with a null id or an empty set are in no set (``set_id`` is null) and have no
    links.  For the rest see ``jaccard_components``.
    """
    p = _prepared(docs, id_col, text_col)
    found = _links(p, all_links=True)
    sizes = p.named.groupBy("node").agg(F.count("*").alias("size"))
    arcs = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = arcs.join(sizes.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("others"))
    return found, _members(p, sizes, others, found)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; columns
    unchanged.  Rows without an id are rows like others, named by a hash of their
    text, and give way to rows with one.  Different texts of one id are pieces of one
    document and stay or go together; of repeated rows one stays.  Texts without words
    are like nothing, not even each other, and stay."""
    text = F.col(text_col).cast("string")
    own = F.lit(1 << 62) + F.xxhash64(F.lit(11), text).bitwiseAND((1 << 62) - 1)
    keyed = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("long"), own))
    found = _saved(jaccard_components(keyed, id_col="__key", text_col=text_col), "join-groups")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = keyed.join(gone, keyed["__key"] == gone["__gone"], "left_anti")
    # ids with several rows are rare: their rows only are compared as a whole
    several = found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    several = _saved(several.select(F.col("doc_id").alias("__several")), "join-several")
    if not several.isEmpty():
        at = kept["__key"] == several["__several"]
        again = kept.join(several, at, "left_semi").withColumn("__text", F.sha2(F.coalesce(text, F.lit("")), 256))
        words = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        once = again.where(words).dropDuplicates(["__key", "__text"]).unionByName(again.where(~words))
        kept = kept.join(several, at, "left_anti").unionByName(once.drop("__text"))
    return kept.drop("__key")
