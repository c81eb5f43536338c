"""The ten operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import string
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dockcast.llm import blocks, decontam, graph, katz, langid, licenses, mixing, ngram_join, quality, token_files, token_rollup, vector_dedup
from dockcast.llm import queries as Q
from dockcast.llm.text import scratch, shingle_set, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
# nulls, blanks, no letters, repeated rows, a long text, extra columns that clash
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", None, 3),
    (4, "12 34 !?", "fr", "a", 8),
    (5, "CC-BY CC BY cc\nby; all rights reserved", "en", "b", 1),
    (5, "CC-BY CC BY cc\nby; all rights reserved", "en", "b", 1),
    (None, "a text without an id", "en", "b", 1),
    (6, "long words " * 40_000, "en", "b", 1),
    (7, "été <|endoftext|> Ünïcode x y Σ ΑΣ", "de", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    clash = ["score", "n_words", "weight", "label", "tokens", "shard", "id", "part", "whole", "kept", "n"]
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def crc_mod(i, m):
    return zlib.crc32(str(i).encode()) % m


# --- helpers ---------------------------------------------------------------


def test_word_and_shingle_hashes_follow_the_words():
    a = word_hashes(b"The  cat\tsat\x0bon the MAT\n")
    b = word_hashes(b"the cat sat on the mat")
    assert (a == b).all() and a[0] == a[4] and len(set(a.tolist())) == 5
    assert len(shingle_set(b"a b c", 5)) == 1 and not len(shingle_set(b" ", 5)) and not len(shingle_set(None, 5))
    assert len(shingle_set(b"a b c d e f a b c d e", 5)) == 6
    assert shingle_set(b"a b c d", 5) != shingle_set(b"a b c d d", 5)


def test_components_of_paths_stars_and_nothing(spark):
    e = [(i + 1, i) for i in range(100, 160)] + [(7, x) for x in range(1000, 1040)] + [(3, 3), (None, 4), (7, 1000)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{x: 7 for x in range(1000, 1040)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op1 -------------------------------------------------------------------


def test_langid_held_out_accuracy_and_fold(spark):
    lang = {r.doc_id: r.lang for r in table(spark, "documents").collect()}
    rows = Q.op1_langid(spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == (crc_mod(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_odd_rows(spark, odd, none):
    model = langid.fit(table(spark, "documents"))
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 4}
    assert all(r.score == 0 and r.rejected for r in rows if r.lang_pred == "und")
    assert langid.fit(none)["langs"] == [] and langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, {"langs": []}).collect()} == {"und"}


# --- op2 -------------------------------------------------------------------


def jaccard_brute(rows):
    """(id, n, component) from all pairs of sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = {i: i for i, _ in rows}
    by_first = {}
    for k, (i, _) in enumerate(rows):  # inverted lists: no pair without a common shingle
        for s in sets[k]:
            by_first.setdefault(s, []).append(k)
    links = set()
    for k in range(len(rows)):
        for j in {j for s in sets[k] for j in by_first[s] if j > k}:
            inter = len(sets[k] & sets[j])
            if rows[k][0] is not None and rows[j][0] is not None and 100 * inter >= 75 * (len(sets[k]) + len(sets[j]) - inter):
                links.add((rows[k][0], rows[j][0]))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return sorted(((i, len(s), comp[i]) for (i, _), s in zip(rows, sets)), key=repr)


def check_join(df, rows):
    got = sorted(map(tuple, ngram_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == jaccard_brute(rows)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", 500)
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 2_000)
    monkeypatch.setattr(ngram_join, "TILE", 8)


def test_ngram_join_on_documents(spark, small_blocks):
    docs = table(spark, "documents")
    check_join(docs, [(r.doc_id, r.text) for r in docs.collect()])


def made_groups():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = []

    def add(ws):
        rows.append((len(rows) * 3, " ".join(ws)))

    # copies of one text with few changes each: not all are similar to each other
    base = [word() for _ in range(120)]
    for _ in range(40):
        ws = list(base)
        for at in rng.choice(120, rng.integers(1, 4), replace=False):
            ws[at] = word()
        add(ws)
    # a chain in which only neighbours are similar
    chain = [word() for _ in range(100)]
    for _ in range(12):
        add(chain)
        chain = [*chain[8:], *[word() for _ in range(8)]]
    # one passage in many otherwise different texts, around the threshold
    passage = [word() for _ in range(60)]
    for k in range(30):
        add([*passage, *[word() for _ in range(k)]])
    for _ in range(3):
        add(base)
        add(["One", "two", "THREE"])
        add(["one", "two", "three", "four", "five"])
        add([word() for _ in range(30)])
    return rows


def test_ngram_join_on_made_groups(spark, small_blocks):
    rows = made_groups()
    check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_ngram_join_odd_rows(spark, odd, none):
    check_join(odd, [(r[0], r[1]) for r in ODD])
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1  # one of the two equal rows of id 5


def test_link_counts_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_links) for r in ngram_join.jaccard_degrees(odd).collect()}
    assert got == {(i, int(i == 5)) for i, *_ in ODD}
    assert ngram_join.jaccard_degrees(none).count() == 0 and ngram_join.jaccard_links(none)[1].count() == 0
    assert ngram_join.jaccard_links(odd)[1].count() == len(ODD)


def test_drop_near_duplicates_looks_at_rows_not_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    near = long + " more"
    rows = [(None, long), (None, long), (None, "apart " * 3 + "only one of these here"), (7, "same words in these two rows here"), (7, "same words in these two rows here"),
            (9, near), (3, "a piece of three on its own here"), (3, "and the other piece of number three"), (None, ""), (None, ""), (4, " "), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.drop_near_duplicates(df).collect()), key=repr)
    # the copies without an id give way to 9, a near copy with one
    assert got == sorted([rows[2], rows[3], rows[5], *rows[6:]], key=repr)
    twins = spark.createDataFrame([(None, long)] * 3, "doc_id long, text string")
    assert ngram_join.drop_near_duplicates(twins).count() == 1


def test_all_links_inside_a_component(spark, small_blocks):
    # a null id, an empty text and a repeated id too
    rows = [*made_groups(), (None, made_groups()[0][1]), (1_000, ""), (0, made_groups()[50][1])]
    shingles = []
    for _, t in rows:
        w = t.translate(LOWER).split()
        shingles.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    mate = lambda s, r: s and r and 100 * len(s & r) >= 75 * len(s | r)
    valid = [k for k, (i, _) in enumerate(rows) if i is not None and shingles[k]]
    number = [sum(j != k and bool(mate(shingles[k], shingles[j])) for j in valid) if k in valid else 0 for k in range(len(rows))]
    comp = [c for *_, c in jaccard_brute(rows)]
    found, members = ngram_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = members.collect()
    counted = ngram_join.jaccard_degrees(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert counted.columns == members.columns and sorted(map(repr, counted.collect())) == sorted(map(repr, got))
    assert sorted((repr(r.doc_id), r.n_shingles, r.n_links) for r in got) == sorted((repr(i), len(s), n) for (i, _), s, n in zip(rows, shingles, number))
    assert sorted(repr(r.component_id) for r in got) == sorted(map(repr, comp))
    sets = list({shingles[k] for k in valid})
    overlaps = [len(sets[i] & sets[j]) for i in range(len(sets)) for j in range(i) if mate(sets[i], sets[j])]
    pairs = found.collect()
    assert sorted(r.overlap for r in pairs) == sorted(overlaps) and all(r.a < r.b for r in pairs)
    assert {r.a for r in pairs} | {r.b for r in pairs} <= {r.set_id for r in got}


def test_first_columns_are_the_same_when_a_task_runs_again(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", 60)
    batch = pa.RecordBatch.from_pylist([{"text": t} for _, t in made_groups()])
    sent = types.SimpleNamespace(value=np.zeros(ngram_join.COUNTERS, np.int64))
    first, again = ([b.to_pylist() for b in ngram_join._first_columns(sent, 1000)([batch])] for _ in range(2))
    inside = {r["bucket"] for b in first for r in b if r["kind"] == 1}
    assert len(inside) > 5 and max(inside) < 1000  # spread over the buckets
    assert first == again


def test_tile_product_joins_components():
    sets = [np.unique(np.array(x, np.uint64)) for x in ([1, 2, 3, 4], [1, 2, 3, 4], [2, 3, 4, 5], [9, 10], [1, 2, 3])]
    got = ngram_join.tile_links(sets, [0, 0, 2, 3, 4])
    assert got == [(0, 4)]  # 0 and 1 are one component; 3/5 and 2/5 are too little


# --- op3 -------------------------------------------------------------------


def test_rollup_is_additive_and_idempotent(spark):
    ddl = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    mk = lambda rows: spark.createDataFrame(rows, ddl)
    store = token_rollup.Rollup(spark, scratch(spark, "rollup-test"))
    assert store.totals().count() == 0
    store.commit(1, mk([(1, "a", "en", "t", 10), (2, "a", None, "t", 5), (None, None, "en", "t", 3), (4, "b", "en", "t", 0)]))
    two = dict(upserts=mk([(1, "b", "en", "t", 7), (5, "a", "en", "t", 1), (5, "a", "en", "t", 1)]), deletes=spark.createDataFrame([(2,), (2,), (99,)], "doc_id long"))
    store.commit(2, **two)
    once = sorted(map(tuple, store.totals().collect()), key=repr)
    store.commit(2, **two)
    assert sorted(map(tuple, store.totals().collect()), key=repr) == once
    assert once == sorted([("a", "en", "t", 2, 2), ("b", "en", "t", 2, 7), (None, "en", "t", 1, 3)], key=repr)
    with pytest.raises(ValueError):
        store.commit(1, mk([]))
    store.commit(3, deletes=spark.createDataFrame([(None,), (1,), (4,), (5,)], "doc_id long"))
    assert store.totals().count() == 0 and store.committed() == [1, 2, 3]


def test_rollup_survives_failures_between_its_writes(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    mk = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    store = token_rollup.Rollup(spark, scratch(spark, "rollup-failing"))
    store.commit(1, mk([(1, "a", "en", "t", 10), (2, "a", "en", "t", 4)]))
    store.commit(2, mk([(1, "a", "en", "t", 5)]))
    parquet = DataFrameWriter.parquet

    def lost(when):
        def write(self, path, *a, **k):
            if "/batch-" in path and when in path:
                raise OSError("lost")
            return parquet(self, path, *a, **k)

        return write

    # a repeat of a committed batch, and a new batch, that can't write
    for batch, when in ((2, "/ledger/"), (2, "/rollup/"), (3, "/ledger/"), (3, "/rollup/")):
        monkeypatch.setattr(DataFrameWriter, "parquet", lost(when))
        try:
            store.commit(batch, mk([(1, "a", "en", "t", 5)] if batch == 2 else [(9, "a", "en", "t", 100)]))
            assert batch == 2
        except OSError:
            assert batch == 3
        monkeypatch.undo()
        assert store.committed() == [1, 2] and [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 2, 9)]
    store.commit(3, mk([(2, "a", "en", "t", 6)]))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 2, 11)]


def test_token_counts_query_revises_counts(spark, monkeypatch):
    commit, seen = token_rollup.Rollup.commit, {}

    def watched(self, batch, upserts=None, deletes=None):
        if upserts is not None:
            seen[batch] = upserts
        commit(self, batch, upserts, deletes)

    monkeypatch.setattr(token_rollup.Rollup, "commit", watched)
    Q.op3_token_counts(spark, SF)
    first, second = ({(r.doc_id, r.tokenizer): r.n_tokens for r in seen[b].where("doc_id % 5 = 0").collect()} for b in (1, 2))
    assert first.keys() == second.keys() and sum(first[k] < second[k] for k in first) > len(first) / 2


def test_token_counts_odd_rows(odd, none):
    got = {(r.doc_id, r.tokenizer): r.n_tokens for r in token_rollup.token_counts(odd).collect()}
    assert got[1, "space_words_v1"] == got[2, "alnum_words_v1"] == got[3, "space_words_v1"] == 0
    assert got[4, "space_words_v1"] == 3 and got[4, "alnum_words_v1"] == 2 and got[6, "space_words_v1"] == 80_000
    assert token_rollup.token_counts(none).count() == 0


# --- op4 -------------------------------------------------------------------


def expected_tokens(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]


def check_files(spark, docs, rows):
    path = scratch(spark, "tokens-test")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start, everything = [], 0, []
    for i, ids in expected_tokens(rows):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        everything += ids
    assert sorted(map(tuple, token_files.read_documents(spark, path).collect()), key=repr) == sorted(want, key=repr)
    for a, n in ((0, 3), (max(0, start - 5), 5), (start // 2, 1000), (0, start)):
        assert token_files.read_range(spark, path, a, n).tolist() == everything[a : a + n]


def test_token_files_round_trip(spark, odd, none, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 100_000)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 5_000)
    docs = table(spark, "documents")
    check_files(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
    check_files(spark, odd, [(r[0], r[1]) for r in ODD])
    check_files(spark, none, [])


def test_a_full_memory_knows_words_without_ids(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 1)
    enc = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("one \u00a0 two", "new \u00a0 one", "\u00a0 \u3000 other"):  # the second finds the memory full
        assert [x.tolist() for x in enc.encode_all([t.encode()])] == [ids[:-1] for _, ids in expected_tokens([(1, t)])]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 20, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    for a, n in ((0, 1001), (1000, 1), (333, 100), (5, 0)):
        assert (token_files.unpack(data, bits, a, n) == ids[a : a + n]).all()
    assert token_files.bits_for(49408) == 16 and token_files.bits_for(65537) == 17 and token_files.bits_for(1) == 1


# --- op5 -------------------------------------------------------------------


def test_mixing_meets_the_repetition_limit(spark):
    docs = table(spark, "documents").withColumn("source", F.when(F.col("doc_id") < 120, "big").otherwise(F.col("source")))
    rows = mixing.mix_sources(docs, repetition_limit=1.5, block_tokens=2000).collect()
    assert len(rows) == docs.count()
    total = sum(r.n_tokens for r in rows)
    by = {}
    for r in rows:
        b = by.setdefault(r.source, [0, 0, r.weight, r.epochs, []])
        b[0] += r.n_tokens
        b[1] += r.n_tokens * r.copies
        b[4].append(r)
    assert abs(sum(b[2] for b in by.values()) - 1) < 1e-9
    # the exponent is as small as the limit allows
    worst = max(b[3] for b in by.values())
    assert 1.49 < worst <= 1.5 + 1e-9
    for source, (tokens, got, weight, epochs, docs_of) in by.items():
        budget = int(weight * total + 1e-6)
        assert got <= budget and budget - got <= max(r.n_tokens for r in docs_of), source
        assert {r.copies for r in docs_of} <= {int(epochs), int(epochs) + 1}
        assert sorted(r.place for r in docs_of) == sorted(np.cumsum([0, *[r.n_tokens for r in sorted(docs_of, key=lambda r: r.place)]])[:-1].tolist())


def test_mixing_meets_a_target_entropy(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "a" if i < 80 else "b" if i < 95 else "c", 0) for i in range(100)], DOCS)
    rows = mixing.mix_sources(docs, target_entropy=0.9).collect()
    w = {r.source: r.weight for r in rows}
    assert abs(-sum(x * np.log(x) for x in w.values()) - 0.9) < 1e-5 and w["a"] > w["b"] > w["c"]
    with pytest.raises(ValueError):
        mixing.mix_sources(docs)


def test_mixing_odd_rows(spark, odd, none):
    rows = mixing.mix_sources(odd, repetition_limit=2.0).collect()
    assert len(rows) == len(ODD)
    assert mixing.mix_sources(none, repetition_limit=2.0).count() == 0
    out = mixing.realise(odd, repetition_limit=2.0)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in rows)


# --- op6 -------------------------------------------------------------------


def contamination(text, items, width=13):
    words = alnum(text)
    hit, names = set(), set()
    for i, t in items:
        ws = alnum(t)
        for a in range(max(1, len(ws) - width + 1) if ws else 0):
            win = ws[a : a + width]
            for at in range(len(words) - len(win) + 1):
                if words[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    names.add(i)
    digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_against_brute_force(spark, odd, none):
    items = [(1, "one two three"), (2, None), (None, "four five"), (3, " - "), (1, "one two three"), (10, " ".join(f"w{i}" for i in range(20))), (9, "three ONE"), (4, "a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    docs = [
        (1, "x One-two THREE one two three one y"), (2, " ".join(f"w{i}" for i in range(3, 17)) + " tail"), (3, "a a a a a b a a"),
        (4, "clean"), (5, " ".join(f"w{i}" for i in range(12))), (6, "pad " * 200 + "one two three"), (7, None), (8, "aéa a a a"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    valid = [(i, t) for i, t in items if i is not None and t]
    got = {r.id: r for r in decontam.find_contamination(df, bench).collect()}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == contamination(t, valid), i
    raw = dict(docs)
    assert [alnum(raw[1].encode()[s.start : s.stop].decode()) for s in got[1].spans] == [["one", "two", "three", "one", "two", "three", "one"]]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(df, bench).collect()) == [4, 5, 6, 7]
    assert decontam.find_contamination(odd, bench).count() == len(ODD)
    assert decontam.drop_contaminated(odd, bench).columns == odd.columns
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.find_contamination(df, bench.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_in_parts_equals_one(spark, odd, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 15, 20])))) for i in range(40)] + [(3, "two texts of it"), (None, "x"), (50, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i if i % 4 else None, " ".join(rng.choices(words, k=rng.choice([0, 5, 60])) + rng.choice(items[:40])[1].split())) for i in range(60)]
    df = spark.createDataFrame([*docs, *docs[:5], (99, None)], "doc_id long, text string").withColumn("name", F.lit("x")).unionByName(odd.select("doc_id", "text", "name" if "name" in odd.columns else F.lit("y").alias("name")))
    one = [sorted(map(repr, f(df, bench).collect())) for f in (decontam.find_contamination, decontam.drop_contaminated)]
    monkeypatch.setattr(decontam, "PART_BYTES", 150)
    assert len(decontam.benchmark_parts(bench)) > 3
    assert one == [sorted(map(repr, f(df, bench).collect())) for f in (decontam.find_contamination, decontam.drop_contaminated)]


def test_drop_contaminated_judges_each_row(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = [(None, "one two three"), (None, "clean"), (7, "clean too"), (7, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, decontam.drop_contaminated(df, bench).collect()), key=repr) == sorted(rows[1:3], key=repr)


# --- op7 -------------------------------------------------------------------


def katz_brute(rows):
    """Per-token Katz scores from plain dictionaries; and the probability table."""
    from collections import Counter

    toks = [([w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))] + ["</s>"], h) for _, t, h in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for ws, held in toks:
        if not held:
            uni.update(ws)
            for a, b in zip(["<s>", *ws], ws):
                bi[a, b] += 1
                ctx[a] += 1

    def discounts(c):
        n = Counter(c.values())
        d, a = {}, 2
        if all(n[r] for r in range(1, 7)):
            a = 6 * n[6] / n[1]
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, 6)} if a < 1 else {}
        if not d or not all(0 < x < 1 for x in d.values()):
            d = {r: 1 - 0.5 / r for r in range(1, 6)}
        return lambda r: d[r] * r if r <= 5 else r - 5 * (1 - d[5])

    N, V = sum(uni.values()), len(uni)
    du, db = discounts(uni), discounts(bi)
    p1 = {w: du(c) / N for w, c in uni.items()}
    unk = 1 - sum(p1.values()) if N else 1.0
    after = {}
    for (a, b), c in bi.items():
        after.setdefault(a, {})[b] = db(c) / ctx[a]
    alpha = {a: (1 - sum(m.values())) / (1 - sum(p1[b] for b in m)) for a, m in after.items()}

    def p(a, b):
        if b in after.get(a, ()):
            return after[a][b]
        return alpha.get(a, 1.0) * p1.get(b, unk)

    out = []
    for (i, _, held), (ws, _) in zip(rows, toks):
        base = sum(np.log10((uni[w] + 0.5) / (N + 0.5 * (V + 1))) for w in ws)
        score = sum(np.log10(p(a, b)) for a, b in zip(["<s>", *ws], ws))
        out.append((i, held, len(ws), sum(w in uni for w in ws), N, base, score))
    return out, p, [*uni, None], list(ctx)


def check_katz(df, rows, held):
    want, p, vocab, contexts = katz_brute(rows)
    got = katz.score_texts(df, held_out=held).collect()
    key = lambda r: (repr(r[0]), r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)
    return p, vocab, contexts


def test_katz_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 3_000)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 5_000)
    docs = table(spark, "documents")
    rows = [(r.doc_id, r.text, crc_mod(r.doc_id, 5) == 1) for r in docs.collect()]
    p, vocab, contexts = check_katz(docs, rows, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    for a in ["<s>", "the", *contexts[:20]]:  # exactly normalised, the unseen word included
        assert abs(sum(p(a, b) for b in vocab) - 1) < 1e-9
    got = Q.op7_katz(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def katz_order(rows, order):
    """Scores (id, score) by recursion over plain dictionaries."""
    from collections import Counter, defaultdict

    toks = [([*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"], h) for _, t, h in rows]
    counts = [Counter() for _ in range(order + 1)]
    for ws, held in toks:
        for j, w in enumerate(ws if not held else []):
            counts[1][(w,)] += 1
            for k in range(2, min(order, j + 2) + 1):
                counts[k][(*["<s>", *ws][j + 2 - k : j + 1], w)] += 1

    def discounts(c):
        n = Counter(c.values())
        d, a = {}, 2
        if all(n[r] for r in range(1, 7)):
            a = 6 * n[6] / n[1]
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, 6)} if a < 1 else {}
        if not d or not all(0 < x < 1 for x in d.values()):
            d = {r: 1 - 0.5 / r for r in range(1, 6)}
        return lambda r: d[r] * r if r <= 5 else r - 5 * (1 - d[5])

    cut = [None, *(discounts(c) for c in counts[1:])]
    total = sum(counts[1].values())
    left = 1 - sum(cut[1](c) for c in counts[1].values()) / total
    after, times = defaultdict(list), Counter()
    for c in counts[2:]:
        for g, r in c.items():
            after[g[:-1]].append(g)
            times[g[:-1]] += r
    known = {}

    def weight(h):
        if h not in known:
            seen = sum(cut[len(g)](counts[len(g)][g]) / times[h] for g in after[h])
            known[h] = (1 - seen) / (1 - sum(p(g[1:]) for g in after[h]))
        return known[h]

    def p(g):
        if r := counts[len(g)][g]:
            return cut[len(g)](r) / (times[g[:-1]] if len(g) > 1 else total)
        return left if len(g) == 1 else (weight(g[:-1]) if times[g[:-1]] else 1) * p(g[1:])

    grams = lambda ws: [(*["<s>", *ws][max(0, j + 2 - order) : j + 1], w) if order > 1 else (w,) for j, w in enumerate(ws)]
    return [(i, sum(np.log10(p(g)) for g in grams(ws))) for (i, *_), (ws, _) in zip(rows, toks)], p, [*(w for w, in counts[1]), None], list(after)


@pytest.mark.parametrize("order", [3, 4])
def test_katz_of_higher_orders_and_its_stored_model(spark, monkeypatch, order):
    import os

    monkeypatch.setattr(katz, "BLOCK_TOKENS", 3_000)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 20_000)
    docs = table(spark, "documents").where("length(text) < 1500").limit(60).localCheckpoint()
    rows = [(r.doc_id, r.text, r.doc_id % 3 == 1) for r in docs.collect()]
    want, p, vocab, contexts = katz_order(rows, order)
    path = scratch(spark, "katz-test")
    got = katz.score_texts(docs, held_out=F.col("doc_id") % 3 == 1, order=order, model_path=path).collect()
    close = lambda a, b: np.allclose([x for _, x in sorted(a)], [x for _, x in sorted(b)], rtol=1e-9, atol=1e-9)
    assert close([(r.doc_id, r.score) for r in got], want)
    for h in contexts[:: max(1, len(contexts) // 30)]:
        assert abs(sum(p((*h, w)) for w in vocab) - 1) < 1e-9
    folder = path.removeprefix("file:")
    for name, first in (("counts", 1), ("weights", 2)):
        assert {f"order={n}" for n in range(first, order + 1)} <= set(os.listdir(f"{folder}/{name}"))
    # texts that the training call never saw, by the tables alone
    fresh = [(10_000 + i, t[: len(t) // 2] + " anew", True) for i, t, _ in rows]
    want, *_ = katz_order([*rows, *fresh], order)
    stored = katz.score_stored(spark.createDataFrame([(i, t) for i, t, _ in [*rows, *fresh]], "doc_id long, text string"), path).collect()
    assert close([(r.doc_id, r.score) for r in stored], want)
    assert {r.train_tokens for r in stored} == {r.train_tokens for r in got}


def test_katz_odd_rows(spark, odd, none):
    rows = [(r[0], r[1], r[0] in (2, 7)) for r in ODD]
    check_katz(odd, rows, F.col("doc_id").isin(2, 7))
    assert katz.score_texts(none, held_out=F.lit(False)).count() == 0
    lone = katz.score_texts(odd, held_out=F.lit(True)).collect()
    assert len(lone) == len(ODD) and all(r.train_tokens == r.n_known == 0 and r.score == 0 for r in lone)


def test_katz_leaves_its_model_and_scores_on_disk_only(spark, monkeypatch, tmp_path):
    import os

    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    made = []
    monkeypatch.setattr(katz, "scratch", lambda spark, name: made.append(str(tmp_path / f"{name}-{len(made)}")) or made[-1])
    rows = [(i, f"a b c{i % 7} a b d{i} e f g{i % 3}", None) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    got = katz.score_texts(docs, held_out=F.col("doc_id") % 3 == 1, order=3, model_path=str(tmp_path / "model"))
    want, *_ = katz_order([(i, t, i % 3 == 1) for i, t, _ in rows], 3)
    assert np.allclose([s for _, s in sorted((r.doc_id, r.score) for r in got.collect())], [s for _, s in sorted(want)], rtol=1e-9, atol=1e-9)
    assert spark.conf.get(setting) == before
    assert [os.path.basename(p).split("-")[1] for p in made if os.path.exists(p)] == ["scores"]
    folders = lambda path: {x for x in os.listdir(tmp_path / "model" / path) if "=" in x}
    assert all(folders(f"counts/order={n}") == {"turn=-1"} for n in (1, 2, 3))
    assert all(folders(f"weights/order={n}") <= {"what=own", "what=shared"} for n in (2, 3))
    again = katz.score_texts(docs, held_out=F.col("doc_id") % 3 == 1, order=3, model_path=str(tmp_path / "model"))  # replaces the model
    assert sorted(again.select("doc_id", "n_known", "train_tokens").collect()) == sorted(got.select("doc_id", "n_known", "train_tokens").collect())


def test_katz_sorts_the_tokens_of_a_turn_once(monkeypatch):
    from collections import Counter

    from dockcast.llm import text

    r = np.random.default_rng(7)
    texts = [None, "", "  ", "One  two\tONE ", "caf\u00e9 x" * 40, *(" ".join(f"w{x}" for x in r.zipf(1.3, n)) for n in (1, 2, 300, 500))] * 3
    held = [i % 4 == 1 for i in range(len(texts))]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(held), pa.array(texts, pa.string())], ["id", "held", "text"])
    sizes, again = [], []
    monkeypatch.setattr(katz, "ranked", lambda keys: sizes.append(len(keys)) or blocks.ranked(keys))
    monkeypatch.setattr(np, "argsort", lambda a, *x, f=np.argsort, **y: again.append(len(a)) or f(a, *x, **y))
    (made,) = katz._make_blocks([rows])
    streams = [[*map(int, text.word_hashes(t and t.encode())), 1] for t in texts]
    lengths, n = [len(x) for x in streams], made.column("n")[0].as_py()
    assert made.column("lengths")[0].as_py() == lengths and sum(lengths) == n
    vocab, tokens, *_ = katz._stream(next(katz._rows([made])))
    assert vocab[tokens].tolist() == sum(streams, [])
    # the keys of end and start are alike in all bits but the last: only those are sorted again
    assert sizes == [n + 2] and sum(again) <= len(texts) + 2
    sizes.clear()
    turns = [list(katz._ask(8, range(2, 3), turn, 2)([made])) for turn in (0, 1)]
    assert len(sizes) == 2 and sum(sizes) == n - len(texts)  # a text's first token ends no three words
    want = Counter()
    for x, h in zip(streams, held):
        for a, b, c in zip([2, *x], x, x[1:]):
            key = 0
            for w in (a, b, c):
                key = int(text.mix(np.array([(key * text._BASE + w) % 2**64], np.uint64))[0]) if key else w
            want[key] += not h
    got = {}
    for turn, out in enumerate(turns):
        for b in out:
            for bucket, keys, counts in zip(b.column("bucket").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                assert bucket % 2 == turn
                got |= dict(zip(blocks.keys_from_bytes(keys).tolist(), blocks.from_counts(counts)))
    assert got == want


def test_codes_of_numbers():
    r = np.random.default_rng(3)
    near = np.array([(1 << 63) + 3, 5, (1 << 63) + 1, (1 << 63) + 3, (1 << 63) + 2] * 20, np.uint64)
    for a in (np.empty(0, np.uint64), near, *(r.integers(0, most, n).astype(np.uint64) for n in (1, 2, 1000) for most in (2, 300, 1 << 40, 1 << 63))):
        assert (blocks.order_of(a) == np.argsort(a, kind="stable")).all()
        assert (blocks.from_planes(blocks.to_planes(a), np.uint64) == a).all()
        assert (blocks.from_counts(blocks.to_counts(a)) == a.astype(float)).all()
        for code in (blocks.to_coded, blocks.to_plain):
            assert (blocks.from_coded(code(a.astype(float))) == a.astype(float)).all()


# --- op8 -------------------------------------------------------------------


def brute_links(rows, threshold=0.98):
    ok = {}
    for k, (i, v, lab) in enumerate(rows):
        if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, float)
    n = {k: 0 for k in range(len(rows))}
    edges = []
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    edges.append((a, b))
    return n, edges


def test_vector_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHUNK", 16)
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for g, (size, noise) in enumerate([(60, 0.02), (40, 0.08), (5, 0.0), (3, 0.13)] + [(1, 0.0)] * 40):
        c = rng.standard_normal(32)
        for _ in range(size):
            rows.append((i, (c + noise * rng.standard_normal(32)).tolist(), g % 2))
            i += 1
    z = [0.0] * 32
    rows += [(900, None, 1), (901, z, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1), (908, [float("inf")] + z[1:], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("size", F.lit(2))
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    links, edges = brute_links(rows)
    assert len(got) == len(rows)
    assert sum(got[r[0]].n_links for r in rows) >= 0.99 * sum(links.values()) > 0
    assert all(got[r[0]].n_links <= links[k] for k, r in enumerate(rows))
    assert got[905].n_links == 1 and got[906].component_id == 905 and not got[906].kept
    comp = {k: k for k in range(len(rows))}
    for _ in range(len(rows)):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert all(got[r[0]].component_id == rows[comp[k]][0] for k, r in enumerate(rows))
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0
    twice = df.where("vec_id = 100").union(df.where("vec_id = 100")).union(df.where("vec_id = 0").withColumn("vec_id", F.lit(None).cast("long")))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(twice).collect() if r.vec_id) == [(100, 1, 100)] * 2


def test_vector_labels_and_extreme_entries(spark):
    # a label that ends as a vector begins, and entries whose squares overflow or vanish
    rows = [(1, [1.0, 2.0], "a"), (2, [2.0], "a,1.0"), (3, [1e200, 1e198], "b"), (4, [1e200, 2e198], "b"), (5, [3e-170, 1e-172], "b"), (6, [-3e-170, 1e-172], "b"),
            (7, [5e-324, 0.0], "c"), (8, [1e308, 1e300], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), 7: (1, 7), 8: (1, 7)}


def test_vector_dedup_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, "embeddings").collect()]
    links, _ = brute_links(rows)
    got = {r.vec_id: r.n_links for r in Q.op8_vector_dedup(spark, SF).collect()}
    assert len(got) == len(rows) and all(got[r[0]] <= links[k] for k, r in enumerate(rows))
    assert sum(got.values()) >= 0.9 * sum(links.values())


# --- op9 -------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op9_quality(spark, sf).collect()
    assert all(r.held_out == (crc_mod(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95 and np.mean([s >= 0.7 for s in good]) > 0.95


def test_quality_odd_rows(spark, odd, none):
    w = quality.fit(table(spark, "documents"), table(spark, "labels"))
    rows = quality.score(odd, w).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(odd, w)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)
    zero = quality.fit(odd, table(spark, "labels").where("false"))
    assert {r.score for r in quality.score(odd, zero).collect()} == {0.5}
    assert quality.score(none, w).count() == 0
    assert not quality.fit(none, table(spark, "labels")).any()


# --- op10 ------------------------------------------------------------------


def license_base(text):
    words = alnum(text)
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def license_labels(text):
    norm = " ".join(alnum(text))
    dets = []
    for r in licenses.rules():
        if r["kw"] in norm:
            for m in re.finditer(r["re"], norm):
                s = norm[: m.start()].count(" ")
                dets.append((s, -(s + m.group().count(" ") + 1), r["prio"], r["label"], r["w"]))
    stop, kept, score = 0, set(), 0.0
    for s, neg, _, label, w in sorted(dets):
        if -neg > stop:
            stop = -neg
            kept.add(label)
            score = max(score, w)
    base = license_base(text)[-1].split(",") if license_base(text)[-1] else []
    return ",".join(sorted(kept | set(base))), max(score, 0.8 if base else 0.0)


def check_licenses(df, rows):
    got = sorted(map(tuple, licenses.scan_licenses(df).collect()), key=repr)
    want = []
    for i, t in rows:
        n, k, a, z, base = license_base(t)
        want.append((i, n, k, a, z, base, *license_labels(t)))
    assert got == sorted(want, key=repr)


def test_licenses_against_brute_force(spark, odd, none):
    made = [
        (1, "Licensed under the Apache License, Version 2.0 and CC BY-SA 4.0. All rights reserved."),
        (2, "GNU General Public License v3; general public license general public license"),
        (3, "cc by cc by x cc\tby accby"), (4, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
        (5, "été cc by été MIT License"), (6, "ACC BYE cc0"), (7, "all rights all rights reserved worldwide"), (8, "MIT License " * 500),
        (9, "SPDX-License-Identifier: BSD-3-Clause"), (10, "creativecommons.org/licenses/by-nc/2.0/ CC-BY-NC"),
    ]
    check_licenses(spark.createDataFrame(made, "doc_id long, text string"), made)
    docs = table(spark, "documents")
    check_licenses(docs, [(r.doc_id, r.text) for r in docs.collect()])
    check_licenses(odd, [(r[0], r[1]) for r in ODD])
    assert licenses.scan_licenses(none).count() == 0
    assert len(licenses.rules()) > 300


def test_licenses_plan_has_no_python(spark):
    plan = licenses.scan_licenses(table(spark, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fine_bins_never_rule_out_a_link():
    """Pairs at and above the threshold pass at every size, also across bin counts
    and with full bins; unrelated long sets, which fill the coarse bins, don't."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 200, 255, 256, 511, 512, 1023, 1024, 20_000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        least = a[: -(-3 * len(a) // 4)]
        more = np.unique(np.concatenate([a, rng.integers(0, 1 << 64, n // 3, dtype=np.uint64)]))
        for b in (a, least, more):
            assert ngram_join.linked(len(np.intersect1d(a, b)), len(a), len(b))
            assert ngram_join.may_link_finely(ngram_join.fine_bins(a), ngram_join.fine_bins(b))
            assert ngram_join.may_link_finely(ngram_join.fine_bins(b), ngram_join.fine_bins(a))
    crowded = np.arange(300, dtype=np.uint64)  # all in one bin
    assert ngram_join.may_link_finely(ngram_join.fine_bins(crowded), ngram_join.fine_bins(crowded[:230]))
    x, y = (np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)) for _ in range(2))
    assert ngram_join.may_link(len(x), np.frombuffer(ngram_join.bins_of(x), np.uint8), len(y), np.frombuffer(ngram_join.bins_of(y), np.uint8)[None])[0]
    assert not ngram_join.may_link_finely(ngram_join.fine_bins(x), ngram_join.fine_bins(y))


def test_a_full_memory_of_words_knows_the_others_for_their_texts_alone():
    """op4: words are encoded without offsets, and once for the texts at hand."""
    import public_tokenizers

    from dockcast.llm.token_files import Encoder

    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"Wort{chr(97 + i % 26)} zwei, drei{chr(97 + i // 26)}! x{i}".encode() for i in range(300)]
    whole = [enc.tok.encode(t.decode(), add_special_tokens=False).ids for t in texts]

    class Fast:
        def __getattr__(self, name):
            assert name != "encode", "offsets that nothing reads"
            return getattr(tok, name)

    tok, enc.tok = enc.tok, Fast()
    enc.most = 5
    assert [x.tolist() for x in enc.encode_all(texts[:9])] == whole[:9]
    known = dict(enc.known)
    assert len(known) >= 5
    for some in (texts, texts[::-1]):
        assert sorted(x.tolist() for x in enc.encode_all(some)) == sorted(whole)
        assert enc.known == known


def test_signs_after_a_letter_are_words_of_their_own():
    """op4: a word is encoded and remembered once, whatever signs and Latin-1 letters it ends with."""
    import random

    import public_tokenizers
    from dockcast.llm.token_files import Encoder

    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert enc.wordwise
    texts = ["Word word### word, été été. été$$$ \"été\" (word)", "a.b. 1. d'. ×. ÷, ª. É% ÿ; e\u0301. =\u0338 x=\u0338 it's. 'll, \u0130. 日。 日."]
    rng = random.Random(4)
    signs = [*"aZéÉß×'\u0301\u0338 \n\t1日", *map(chr, range(33, 48)), *":;<=>?@[\\]^_`{|}~", "'s", "'ll"]
    texts += ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    got = [x.tolist() for x in enc.encode_all([t.encode() for t in texts])]
    assert got == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    lone = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    list(lone.encode_all([texts[0].encode()]))
    assert set(lone.known) == {x.encode() for x in ("word", "###", ",", "été", ".", "$$$", '"été', '"', "(word", ")")}
