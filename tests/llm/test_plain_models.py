"""op1 and op9 against plain loops over words, grams and weights."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockcast.llm import langid, mixing, quality
from dockcast.llm.text import hash_share, mix, span_hashes

SF = "/root/testdata/sf0.001"
TEXTS = [
    "The cat sat. On the MAT!", "the the dog\tran away, 12 times", "Der Hund lief weg", "das Haus ist GROSS und alt", "été à la plage", "le chat dort", "dort le chat le",
    "x", "a b c a b c", "word" * 30, "Ünïcode straße", "mat cat the", "12 34", "!!", " ", "",
]


# --- language identification -------------------------------------------------


def grams(text):
    """Slot -> count of the 1- to 3-grams of bytes, blanks in a row as one."""
    out, run = {}, bytearray(b" ")
    for byte in text.encode() + b" ":
        if 0x41 <= byte <= 0x5A:
            byte += 32
        letter = 0x61 <= byte <= 0x7A or byte >= 0x80
        if letter or run[-1] != 0x20:
            run.append(byte if letter else 0x20)
    for n in (1, 2, 3):
        for i in range(len(run) - n + 1):
            gram = 0
            for byte in run[i : i + n]:
                gram = gram * 256 + byte
            slot = ((gram + n * 2**28) % 2**32 * 2654435761 % 2**32) >> 20
            out[slot] = out.get(slot, 0) + 1
    return out


def unit(counts, idf):
    v = {s: math.log1p(c) * idf[s] for s, c in counts.items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {s: x / length for s, x in v.items()}


def test_langid_equals_a_plain_scorer(spark):
    rows = [(i, t, ["en", "en", "de", "de", "fr", "fr", "fr"][i] if i < 7 else None) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    taught = [grams(t) for _, t, lang in rows if lang]
    idf = [math.log((1 + len(taught)) / (1 + sum(s in g for g in taught))) + 1 for s in range(langid.DIMS)]
    assert np.allclose(model["idf"], idf, rtol=1e-12)
    # with no more texts than centroids, each text is one
    for lang in ("en", "de", "fr"):
        mine = sorted(tuple(np.round(c, 9)) for name, c in zip(model["langs"], model["centroids"]) if name == lang)
        want = []
        for _, t, other in rows:
            if other == lang:
                v = np.zeros(langid.DIMS)
                for s, x in unit(grams(t), idf).items():
                    v[s] = x
                want.append(tuple(np.round(v, 9)))
        assert len(mine) <= langid.CENTROIDS and set(mine) <= set(want) or len(mine) == len(want)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        v = unit(grams(t), idf)
        cos = [sum(x * c[s] for s, x in v.items()) for c in model["centroids"]]
        best = max(range(len(cos)), key=lambda k: (round(cos[k], 12), -k))
        assert got[i].lang_pred == model["langs"][best] and abs(got[i].score - min(max(cos[best], 0), 1)) < 1e-12


def test_every_language_can_be_predicted(spark):
    alphabet = [chr(0x4E00 + 40 * k) for k in range(260)]
    rows = [(3 * k + j, " ".join([c * 3, c * 2, c][: j + 1]), f"l{k:03d}") for k, c in enumerate(alphabet) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(set(model["langs"])) == 260
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.9 * len(rows)


# --- quality ------------------------------------------------------------------


def hashed(word: bytes) -> int:
    buf = np.frombuffer(word, np.uint8)
    return int(span_hashes(buf, np.array([0]), np.array([len(buf)]))[0])


def plain_features(text):
    """slot -> list of values, from words and shapes of words."""
    out = [(0, 1.0)]
    words = [w for w in text.encode().split(b" ") if w]
    words = [p for w in words for p in w.replace(b"\t", b" ").replace(b"\n", b" ").split()]
    if not words:
        return out
    lower = [hashed(w.lower()) for w in words]

    def shape(w):
        kinds = [b"A" if 0x41 <= c <= 0x5A else b"0" if 0x30 <= c <= 0x39 else b"a" if 0x61 <= c <= 0x7A or c >= 0x80 else bytes([c]) for c in w]
        return b"".join(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1])

    shapes = [hashed(shape(w)) for w in words]
    golden = 0x9E3779B97F4A7C15
    for salt, (x, same) in enumerate(((lower, True), (shapes, False))):
        two = [1 if same and a == b else (a * golden + b) % 2**64 for a, b in zip(x, x[1:])]
        for n, g in enumerate((x, two)):
            counts = {}
            for h in g:
                key = np.array([(h + (2 * salt + n + 1) * golden) % 2**64], np.uint64)
                slot = 1 + int(mix(key)[0]) % ((1 << quality.BITS) - 1)
                counts[slot] = counts.get(slot, 0) + 1
            out += [(s, math.sqrt(c / len(g))) for s, c in counts.items()]
    return out


def plain_ftrl(rows):
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        shrunk = math.copysign(quality.L1, z[i]) - z[i]
        return shrunk / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for epoch in range(quality.EPOCHS):
        for j in np.random.default_rng(epoch).permutation(len(rows)):
            text, y = rows[j]
            f = plain_features(text)
            w = [weight(i) for i, _ in f]
            p = 1 / (1 + math.exp(-sum(a * x for a, (_, x) in zip(w, f))))
            old = {i: n.get(i, 0.0) for i, _ in f}
            for a, (i, x) in zip(w, f):
                g = (p - y) * x
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old[i] + g * g) - math.sqrt(old[i])) / quality.ALPHA * a
                n[i] = n.get(i, 0.0) + g * g
    return weight


def test_quality_equals_a_plain_loop(spark):
    rows = [(i, t, int(len(t) % 3 > 0)) for i, t in enumerate(TEXTS[:13] * 3)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    w = quality.fit(docs, labels)
    order = [r.i for r in spark.createDataFrame(rows, "i long, t string, y int").orderBy(hash_share(F.lit(31), F.col("i")), "y", "t").collect()]
    weight = plain_ftrl([rows[i][1:] for i in order])
    scores = {r.doc_id: r.score for r in quality.score(docs, w).collect()}
    for i, t, _ in rows:
        s = sum(weight(k) * x for k, x in plain_features(t))
        assert abs(scores[i] - 1 / (1 + math.exp(-s))) < 1e-9, t
    assert len({round(s, 6) for s in scores.values()}) > 8


# --- mixing -------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 3])
def test_places_don_t_depend_on_how_blocks_are_summed(spark, monkeypatch, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(repr, mixing.mix_sources(docs, repetition_limit=1.25, block_tokens=500).collect()))
    monkeypatch.setattr(mixing, "SPAN_BLOCKS", most)
    assert one == sorted(map(repr, mixing.mix_sources(docs, repetition_limit=1.25, block_tokens=500).collect()))
