"""Toxicity by a weighted finite-state grammar of clauses.

Words become classes (insult, threat, future, target, negation, report, other); stops
and line ends close a clause.  Five transducers read the classes in turn: negation marks
the words in its scope, reported speech the rest of its clause, target what stands near
a person, threat joins a verb with its future and its victim, insult joins an insult
with its target.  Their composition with the clause, which keeps the gravest match, is
compiled to one deterministic table, and a text is read by that table once.  Each
clause yields one kind of match or none; the score is a logistic function of the
numbers of clauses of each kind.

The weights of the kinds have given values which the labels correct (the fit is a
penalised likelihood around them), so a kind that the sample doesn't show keeps its
value.  Words that the sample shows in toxic texts only are insults too, and insults
that it shows in clean texts are not.

Null and empty texts have no clauses and the score of that.  Repeated rows each get a
row.  Without usable labels the given weights hold.  Empty tables: no rows.  Only the
named columns are read.  Spans count UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockcast.llm.text import ALNUM_WORD, NOT_ALNUM, binary, hash_share, pieces, shipped, small_batches, span_hashes, spans, written

SAMPLE_ROWS = 8000  # the training sample's bound
LEARNED_WORDS = 2000  # at most, the most frequent ones
THRESHOLD = 0.5
CHUNK = 1 << 20  # bytes read at once

OTHER, INSULT, THREAT, FUTURE, TARGET, NEGATION, REPORT, BREAK = range(8)
BREAKS = b".!?;\n\r"

# the words of each class: fixed values
WORDS = {
    INSULT: """idiot idiots idiotic moron morons moronic imbecile imbeciles cretin dumbass dumb stupid stupidity fool fools foolish
        clown clowns loser losers scum scumbag trash garbage filth filthy vermin worthless pathetic disgusting revolting repulsive
        despicable pig pigs swine bastard bastards bitch bitches asshole assholes jerk jerks dickhead prick slut whore wanker
        twat cunt retard retarded freak freaks parasite parasites coward cowards liar liars degenerate degenerates lowlife
        nobody brainless clueless useless hideous vile braindead idioten dummkopf trottel arschloch arschlöcher schwachkopf
        drecksau miststück hurensohn abschaum versager imbécile crétin connard connasse salope ordure débile abruti idiota idiotas
        estúpido estúpida imbécil cabrón gilipollas pendejo basura inútil asqueroso""",
    THREAT: """kill kills hurt destroy burn beat stab shoot strangle murder crush punch slaughter hang hunt smash attack
        töten umbringen erschießen verprügeln tuer frapper égorger matar golpear degollar""",
    FUTURE: "will gonna going shall ll must should deserve deserves werde werden vais va voy",
    TARGET: """you your yours yourself u ur he she they them him her his their these those people everyone du dich dir ihr
        euch tu toi te vous ustedes""",
    NEGATION: "not never no isn aren wasn weren don doesn didn won cannot hardly neither nor nicht kein keine nie pas jamais nunca",
    REPORT: "said says say told tells called calls wrote writes quoted quotes claimed claims according reported accused sagte dijo",
}

# flags of a symbol on its way through the transducers
NEGATED, REPORTED, AIMED, PLANNED = 1, 2, 4, 8
WHATS = ("insult", "aimed insult", "several insults", "threat", "planned threat", "aimed threat")
MANNERS = ("plain", "negated", "reported")
KINDS = tuple(f"{m} {w}" for w in WHATS for m in MANNERS)
# given weights: of each match, times its manner's share; then the constant
_GRAVITY = (2.0, 3.5, 4.0, 1.0, 2.0, 5.0)
_SHARE = (1.0, 0.15, 0.35)
GIVEN = np.array([g * s for g in _GRAVITY for s in _SHARE])
BASE = -3.0


class Transducer(NamedTuple):
    """``step(state, symbol) -> (state, symbol)``, one symbol out for each one in."""

    start: object
    step: Callable


def compose(a: Transducer, b: Transducer) -> Transducer:
    """``b`` reads what ``a`` writes."""

    def step(state, symbol):
        first, between = a.step(state[0], symbol)
        second, out = b.step(state[1], between)
        return (first, second), out

    return Transducer((a.start, b.start), step)


def negation(scope: int = 3) -> Transducer:
    """Marks the words after a negation; a second one within the scope takes it back."""

    def step(left, symbol):
        what, flags = symbol
        if what == BREAK:
            return 0, symbol
        if what == NEGATION:
            return (0 if left else scope), (OTHER, flags)
        return max(left - 1, 0), (what, flags | NEGATED if left else flags)

    return Transducer(0, step)


def reported_speech() -> Transducer:
    """Marks what follows a verb of report in its clause; the verb itself passes."""

    def step(told, symbol):
        what, flags = symbol
        if what == BREAK:
            return False, symbol
        return told or what == REPORT, (what, flags | REPORTED if told else flags)

    return Transducer(False, step)


def target(reach: int = 4) -> Transducer:
    """Marks insults that follow a person."""

    def step(left, symbol):
        what, flags = symbol
        if what == BREAK:
            return 0, symbol
        if what == TARGET:
            return reach, symbol
        return max(left - 1, 0), (what, flags | AIMED if left and what == INSULT else flags)

    return Transducer(0, step)


def threat(reach: int = 3) -> Transducer:
    """A verb after a future is planned; the person after a verb makes it aimed: that
    person's symbol becomes the threat again."""

    def step(state, symbol):
        future, left, held = state
        what, flags = symbol
        if what == BREAK:
            return (0, 0, 0), symbol
        if what == FUTURE:
            return (reach, 0, 0), (OTHER, flags)
        if what == THREAT:
            flags |= PLANNED if future else 0
            return (0, reach, flags), (THREAT, flags)
        if what == TARGET and left:
            return (0, 0, 0), (THREAT, held | AIMED)
        return (max(future - 1, 0), max(left - 1, 0), held if left > 1 else 0), symbol

    return Transducer((0, 0, 0), step)


def insult(reach: int = 2) -> Transducer:
    """A person right after an insult makes it aimed, as one before it does."""

    def step(state, symbol):
        left, held = state
        what, flags = symbol
        if what == BREAK:
            return (0, 0), symbol
        if what == INSULT:
            return (reach, flags), symbol
        if what == TARGET and left:
            return (0, 0), (INSULT, held | AIMED | PLANNED)  # planned: the same insult once more
        return (max(left - 1, 0), held if left > 1 else 0), symbol

    return Transducer((0, 0), step)


def clause() -> Transducer:
    """Keeps the gravest match (0: none) and writes it at the clause's end."""

    def kind(what: int, flags: int) -> int:
        return 1 + 3 * what + (2 if flags & REPORTED else 1 if flags & NEGATED else 0)

    def graver(a: int, b: int) -> int:
        return max(a, b, key=lambda k: (GIVEN[k - 1] if k else 0.0, k))

    def step(state, symbol):
        held, insults = state
        what, flags = symbol
        if what == BREAK:
            return (0, False), held
        if what == INSULT:
            new = kind(1 if flags & AIMED else 0, flags)
            if insults and not flags & (NEGATED | REPORTED | PLANNED):
                new = kind(2, 0)
            return (graver(held, new), insults or not flags & (NEGATED | REPORTED)), 0
        if what == THREAT:
            return (graver(held, kind(5 if flags & AIMED else 4 if flags & PLANNED else 3, flags)), insults), 0
        if what == REPORT and held:  # "..., she said"
            return (3 * ((held - 1) // 3) + 3, insults), 0
        return state, 0

    return Transducer((0, False), step)


class Table(NamedTuple):
    """A composed transducer: for state and class the next state and what is written."""

    then: np.ndarray
    out: np.ndarray


def compiled(t: Transducer) -> Table:
    """All states that can be reached."""
    number, queue, then, out = {t.start: 0}, [t.start], [], []
    for state in queue:
        rows = [t.step(state, (what, 0)) for what in range(BREAK + 1)]
        for s, _ in rows:
            if s not in number:
                number[s] = len(number)
                queue.append(s)
        then.append([number[s] for s, _ in rows])
        out.append([x if isinstance(x, int) else 0 for _, x in rows])
    return Table(np.array(then, np.int32), np.array(out, np.int8))


def grammar() -> Table:
    whole = negation()
    for t in (reported_speech(), target(), threat(), insult(), clause()):
        whole = compose(whole, t)
    return compiled(whole)


def _hashes(words: list[str]) -> np.ndarray:
    """Hashes of words (of ASCII letters, digits and non-ASCII characters), as in a text."""
    buf = np.frombuffer(" ".join(words).encode().lower(), np.uint8)
    return span_hashes(buf, *spans(buf, ALNUM_WORD)) if len(buf) else np.empty(0, np.uint64)


class Model(NamedTuple):
    keys: np.ndarray  # sorted word hashes
    classes: np.ndarray
    table: Table
    weights: np.ndarray  # of the kinds
    base: float


def lexicon(insults: list[str] = (), harmless: list[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and classes: the given words with learned insults added and
    harmless ones taken away.  A word of two classes has the first."""
    known = {}
    for what, words in WORDS.items():
        for w in words.split():
            known.setdefault(w, what)
    for w in insults:
        known.setdefault(w, INSULT)
    for w in harmless:
        known.pop(w, None)
    names = sorted(known)
    keys = _hashes(names)
    order = np.argsort(keys)
    return keys[order], np.array([known[w] for w in names], np.uint8)[order]


class Reader:
    """Reads texts by the table."""

    def __init__(self, model: Model):
        self.keys, self.classes = model.keys, model.classes
        self.then, self.out = model.table.then.tolist(), model.table.out.tolist()

    def _classes(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(starts), np.uint8)
        h = span_hashes(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.classes[at], 0).astype(np.uint8)

    def clauses(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(kind, start, end) of the clauses with a match, from the first to the last word."""
        state, begun, last, done = 0, None, 0, 0
        while done < len(text):
            stop = len(text)
            if done + CHUNK < stop:  # cut after a clause, else before a word
                cuts = [text.rfind(bytes([c]), done, done + CHUNK) for c in BREAKS]
                stop = max(cuts) + 1
                if stop <= done:
                    stop = text.find(b" ", done + CHUNK)
                    stop = len(text) if stop < 0 else stop
            part = text[done:stop].lower()
            buf = np.frombuffer(part, np.uint8)
            starts, ends = spans(buf, ALNUM_WORD)
            classes = self._classes(buf, starts, ends)
            closed = np.flatnonzero(np.isin(buf, np.frombuffer(BREAKS, np.uint8)))
            at = np.searchsorted(closed, starts)  # clause of each word
            wanted = np.unique(at[(classes == INSULT) | (classes == THREAT)]).tolist()
            if begun is not None and (not wanted or wanted[0]):
                wanted.insert(0, 0)
            if len(at) and stop < len(text) and at[-1] == len(closed) and (not wanted or wanted[-1] != at[-1]):
                wanted.append(int(at[-1]))  # goes on in the next part
            for c in wanted:
                a, b = np.searchsorted(at, [c, c + 1])
                if begun is None:
                    state, begun = 0, done + int(starts[a])
                for what in classes[a:b].tolist():
                    state = self.then[state][what]
                last = done + int(ends[b - 1]) if b > a else last
                if c < len(closed) or stop == len(text):
                    kind = self.out[state][BREAK]
                    if kind:
                        yield kind - 1, begun, last
                    state, begun = 0, None
            done = stop

    def counts(self, text: bytes | None) -> np.ndarray:
        out = np.zeros(len(KINDS))
        if text:
            for kind, _, _ in self.clauses(text):
                out[kind] += 1
        return out


def _features(counts: np.ndarray) -> np.ndarray:
    return np.log2(1 + counts)


def _fitted(x: np.ndarray, y: np.ndarray, rate: float, spread: float = 2.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and constant by Newton steps on the likelihood, with a normal prior
    around the given weights; ``rate`` corrects for the sample's share of toxic rows."""
    x = np.column_stack((x, np.ones(len(x))))
    prior = np.append(GIVEN, BASE + rate)
    hold = np.append(np.full(len(GIVEN), 1 / spread**2), 1e-3)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (y - p) - hold * (w - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1] - rate)


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: Column | None = None
) -> Model:
    """The grammar with its words and weights, learned from labelled rows.

    ``train`` selects the labels to learn from, by their id column.  Null ids, labels
    and texts teach nothing; an id with several labels teaches each.  The sample is
    taken by a hash of the id: at most SAMPLE_ROWS labels, half of each kind where
    there are enough, and at most twice as many rows of texts.
    """
    table = grammar()
    given = Model(*lexicon(), table, GIVEN, BASE)
    lab = labels.where(train) if train is not None else labels
    lab = lab.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).where("__id is not null and y in (0, 1)")
    sizes = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    if not sizes:
        return given
    share = hash_share(F.lit(37), F.col("__id"))
    # 0.8: a hash sample may exceed its expectation; the limit is the hard bound
    rate = F.create_map(*[F.lit(v) for y, n in sizes.items() for v in (y, min(1.0, 0.8 * SAMPLE_ROWS / 2 / n))])
    lab = lab.where(share < rate[F.col("y")]).orderBy(share, "y").limit(SAMPLE_ROWS)
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = written(text.join(F.broadcast(lab), "__id").select("y", "text"), "toxicity-sample")

    # words of toxic texts only, and insults of clean texts: counted once for each text
    word = F.explode(F.array_distinct(F.split(F.lower("text"), f"[{NOT_ALNUM}]+"))).alias("word")
    seen = rows.select("y", word).where("word <> ''").groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("fine"))
    given_one = F.col("word").isin(WORDS[INSULT].split())
    harmful = ~given_one & F.expr("bad >= 20 and fine * 50 <= bad")
    told = seen.where(harmful | (given_one & F.expr("fine >= 5 and fine >= bad")))
    found = told.orderBy(given_one.desc(), F.desc("bad"), "word").limit(LEARNED_WORDS).select("word", given_one.alias("given")).collect()
    insults, harmless = [r.word for r in found if not r.given], [r.word for r in found if r.given]
    words = lexicon(insults, harmless)

    sent = shipped(docs.sparkSession, given._replace(keys=words[0], classes=words[1]))

    def run(batches):
        reader = Reader(sent.value)
        for b in pieces(batches, "text"):
            x = [reader.counts(t).tolist() for t in binary(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(run, "y int, x array<double>").limit(2 * SAMPLE_ROWS).collect()
    if not got:
        return sent.value
    x, y = _features(np.array([r.x for r in got])), np.array([r.y for r in got], float)
    # the sample's odds against those of all labels
    odds = (y.sum() + 1e-9) / ((1 - y).sum() + 1e-9)
    whole = (sizes.get(1, 0) + 1e-9) / (sizes.get(0, 0) + 1e-9)
    weights, base = _fitted(x, y, float(np.log(odds / whole)) if 0 < y.sum() < len(y) else 0.0)
    return Model(*words, table, weights, base)


def score_counts(counts: np.ndarray, model: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.base + _features(counts) @ model.weights, -35, 35))))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (score >= 0.5),
    n_clauses (with a match) and kinds (of these, sorted, comma-joined)."""
    sent = shipped(docs.sparkSession, model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_clauses", pa.int64()), ("kinds", pa.string())])

    def run(batches):
        m = sent.value
        reader = Reader(m)
        for b in pieces(batches, "text"):
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), binary(b, "text")):
                n = reader.counts(t)
                s = score_counts(n, m)
                rows.append((i, s, int(s >= THRESHOLD), int(n.sum()), ",".join(sorted(k for k, c in zip(KINDS, n) if c))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    small_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, score double, predicted int, n_clauses long, kinds string")


def matched_clauses(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per clause with a match: doc_id, kind, weight, start and end."""
    sent = shipped(docs.sparkSession, model)
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("weight", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        m = sent.value
        reader = Reader(m)
        for b in pieces(batches, "text", 1 << 20):
            rows = [
                (i, KINDS[kind], float(m.weights[kind]), start, end)
                for i, t in zip(b.column("doc_id").to_pylist(), binary(b, "text"))
                for kind, start, end in reader.clauses(t or b"")
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    small_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, kind string, weight double, start long, end long")
