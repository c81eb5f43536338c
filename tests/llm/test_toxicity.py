"""Toxicity: the grammar by cases, the table against the transducers run one after
another, spans, held-out figures."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockcast.llm import queries as Q
from dockcast.llm import toxicity as T

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return T.Model(*T.lexicon(), T.grammar(), T.GIVEN, T.BASE)


def kinds(model, text):
    return [T.KINDS[k] for k, _, _ in T.Reader(model).clauses(text.encode())]


@pytest.mark.parametrize(
    "text, want",
    [
        ("What an idiot.", ["plain insult"]),
        ("You are an IDIOT!", ["plain aimed insult"]),
        ("idiot you", ["plain aimed insult"]),
        ("He is not an idiot.", ["negated aimed insult"]),
        ("It is not the case that this very old clown", ["plain insult"]),  # out of scope
        ("She said that they are scum. Trash.", ["reported aimed insult", "plain insult"]),
        ("You moron, she said", ["reported aimed insult"]),
        ("A moron, a loser; a clown", ["plain several insults", "plain insult"]),
        ("I will kill you", ["plain aimed threat"]),
        ("They will burn it", ["plain planned threat"]),
        ("kill the process", ["plain threat"]),
        ("I will never kill you", ["negated aimed threat"]),
        ("idiots!!! stupid### $$$moron$$$", ["plain insult", "plain several insults"]),
        ("you will see. the idiotproof door", []),
        ("", []),
        ("...\n!?", []),
    ],
)
def test_clauses(model, text, want):
    assert kinds(model, text) == want


def test_table_equals_the_transducers_in_a_row(model):
    rng = random.Random(3)
    chain = [T.negation(), T.reported_speech(), T.target(), T.threat(), T.insult(), T.clause()]
    for _ in range(300):
        states, at = [t.start for t in chain], 0
        for what in [rng.randrange(T.BREAK + 1) for _ in range(30)] + [T.BREAK]:
            symbol = (what, 0)
            for i, t in enumerate(chain):
                states[i], symbol = t.step(states[i], symbol)
            assert (symbol if isinstance(symbol, int) else 0) == model.table.out[at, what]
            at = model.table.then[at, what]


def test_long_texts_are_read_whole_in_parts(model, monkeypatch):
    text = "one two. you idiot three! " * 3 + "no stops here " * 30 + "worthless " + "and so on " * 40 + "? scum, he said\nkill you"
    whole = list(T.Reader(model).clauses(text.encode()))
    assert [text.encode()[a:b].split()[0] for _, a, b in whole] == [b"you"] * 3 + [b"no", b"scum,", b"kill"]
    for chunk in (1, 7, 30, 64, 200):
        monkeypatch.setattr(T, "CHUNK", chunk)
        assert list(T.Reader(model).clauses(text.encode())) == whole


def test_held_out_scores(spark):
    rows = {r.doc_id: r for r in Q.op11_toxicity(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    assert all(r.predicted == (r.score >= 0.5) for r in rows.values())
    insulted = {i for i, t in docs.items() if {"idiot", "moron", "scum", "loser"} & set(t.lower().split())}
    held = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    clean = [r for r, toxic in held if toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    toxic = [r for r, toxic in held if toxic and r.doc_id in insulted]
    assert toxic and all(r.predicted for r in toxic)


def test_labels_teach_words_and_weights(spark):
    text = {0: "a plain zorgle text", 1: "such a blorf here"}
    docs = spark.createDataFrame([(i, text[i % 2] if i % 5 else "all the trash goes out") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("text").contains("blorf"), 1).otherwise(0).alias("toxic"))
    model = T.fit(docs, labels)
    assert kinds(model, "blorf") == ["plain insult"] and kinds(model, "zorgle") == [] and kinds(model, "trash") == []
    scores = {r.text: r.score for r in T.score(docs, model).join(docs, "doc_id").collect()}
    assert scores[text[1]] > 0.9 and scores[text[0]] < 0.1
    # what the sample doesn't show keeps its given weight
    assert np.allclose(model.weights[3 * 5], T.GIVEN[3 * 5])


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " \t\n.!"), (None, "you idiot"), (4, "you idiot"), (4, "you idiot"), (5, "été 日本 idiot\0"), (6, "worthless " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("y", "score", "kinds", "word", "__id")})
    got = T.score(df, model).collect()
    assert len(got) == len(rows) and {r.score for r in got if r.doc_id in (1, 2, 3)} == {T.score_counts(np.zeros(18), model)}
    assert sum(r.n_clauses for r in got if r.doc_id in (None, 4)) == 3 and all(r.n_clauses == 1 for r in got if r.doc_id in (5, 6))
    spans = {(r.doc_id, r.kind, r.start, r.end) for r in T.matched_clauses(df, model).collect()}
    assert (4, "plain aimed insult", 0, 9) in spans and (5, "plain insult", 0, 18) in spans
    none = df.where("false")
    assert T.score(none, model).count() == 0 and T.matched_clauses(none, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (4, 1), (4, 0), (6, 1), (7, 5)], "doc_id long, toxic int")
    for d, l in ((none, labels), (df, labels.where("false")), (none, labels.where("false"))):
        empty = T.fit(d, l)
        assert np.allclose(empty.weights, T.GIVEN) and empty.base == T.BASE
    odd = T.fit(df, labels)
    assert np.isfinite(odd.weights).all() and np.isfinite(odd.base)
