"""Conversation repair against a row-by-row search."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from dockcast.llm import conversations
from dockcast.llm import queries as Q

SF = "/root/testdata/sf0.001"
TO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ADD = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def added(q):
    return TO[q, ADD[q][0]]


def cheapest(rows):
    """(cost, letters, lines) over rows of (role, text, fault), by all states in turn."""

    def widen(best):
        for _ in range(3):
            for q, (c, a, lines) in list(best.items()):
                new = (c + 2, a + "I", lines + [ADD[q] + ":"])
                if added(q) not in best or new[:2] < best[added(q)][:2]:
                    best[added(q)] = new
        return best

    best = widen({0: (0, "", [])})
    for role, text, fault in rows:
        then = {}

        def offer(q, new):
            if q not in then or new[:2] < then[q][:2]:
                then[q] = new

        for q, (c, a, lines) in best.items():
            offer(q, (c + 3, a + "D", lines))
            if fault in ("", "truncated"):
                cut = fault == "truncated"
                if (q, role[:1]) in TO:
                    offer(TO[q, role[:1]], (c + cut, a + "K", lines + [f"{role}:{text}"]))
                offer(added(q), (c + 2 + cut, a + "R", lines + [f"{ADD[q]}:{text}"]))
        best = widen(then)
    return min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])


def expected(rows):
    """The contract's columns of one conversation from (turn, role, text) in any order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, marked = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, letters, lines = cheapest(marked)
    turns = {t for t, _, _ in rows if t is not None}
    n = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *n, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(rows), len(lines))


def of(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_runs_cost_and_letters_equal_the_search():
    rng = random.Random(5)
    for case in range(300):
        runs, rows = conversations.Runs(), []
        for _ in range(rng.randint(0, 7)):
            symbol, n = rng.randrange(9), rng.choice([1, 1, 2, 3, 7, 40])
            runs.add(symbol, n)
            role = "x" if symbol == 0 else "suax"[(symbol - 1) // 2]
            rows += [(role, "t", "blank" if symbol == 0 else "truncated" if (symbol - 1) % 2 else "")] * n
        cost, letters, lines = cheapest(rows)
        assert runs.best(part=rng.choice([1, 2, 1 << 16])) == (cost, letters), case
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_a_run_of_a_million_rows_needs_its_powers_only():
    runs = conversations.Runs()
    runs.add(3, 1_000_000)  # users only: the cheapest is to give every second one another role
    cost, letters = runs.best()
    assert cost == 1_000_000 and letters == "KR" * 500_000


def test_query_equals_the_search_on_every_conversation(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        mine = rows.setdefault(r.conv_id, [])
        draw = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", r.text) if draw == 2 else r.text
        if draw:
            mine += [(r.turn, "user" if draw == 4 else r.role, text)] * (2 if draw == 3 else 1)
    assert of(Q.op12_conversation_repair(spark, SF)) == {c: expected(x) for c, x in rows.items()}


ODD = [
    (None, 0, "user", "Hi."), (None, 1, "assistant", None), (1, None, None, "No turn."), (1, None, "user", "x"), (1, 3, "user", "x"),
    (1, 3, "user", "x"), (1, 9, "", "no role."), (1, 9, "agent", "An initial."), (2, 0, "system", "s" * 300_000 + " " * 50_000), (3, 0, "user", " \t\r\n\x0b\x0c"),
    (4, 5, "User", "Other case!"), (4, -7, "assistant", " "), (5, 1, "user", "a\0b?"), (5, 1, "user", "é. \n"), (5, 1, "assistant", "é. \n"),
]


def test_odd_rows(spark):
    rows = spark.createDataFrame(ODD * 2 + [(6, 1, "user", "Same.")] * 500, "conv_id long, turn long, role string, text string")
    df = rows.withColumns({c: F.lit("x") for c in ("conv", "kind", "mark", "fault", "copies", "symbol", "place", "edit", "c", "r", "m", "first")})
    want = {}
    for c, t, r, x in ODD * 2 + [(6, 1, "user", "Same.")] * 500:
        want.setdefault(c, []).append((t, r, x))
    want = {c: expected(x) for c, x in want.items()}
    empty = hashlib.sha256(b"").hexdigest()
    names = spark.createDataFrame([(7,), (7,), (1,)], "conv_id long")
    assert of(conversations.audit(df, names)) == want | {7: (0, 0, 0, 0, 0, 0, "", empty, 0, 0)}
    lines = {}
    for r in sorted(conversations.repair(df).collect(), key=lambda r: r.place):
        assert r.place == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: x[7] for c, x in want.items() if x[9]}
    assert conversations.damaged(df).count() > 0
    none = df.where("false")
    assert conversations.audit(conversations.damaged(none), none).count() == 0 and conversations.repair(none).count() == 0


def test_text_conversation_ids_keep_their_type(spark):
    df = spark.createDataFrame([("a:b", 1, "user", "Hi."), ("a:b", 2, "assistant", "Yes.")], "name string, at int, who string, said string")
    got = conversations.audit(df, conv_col="name", turn_col="at", role_col="who", text_col="said").collect()
    assert [(r.conv_id, r.cost, r.audit) for r in got] == [("a:b", 0, "KK")]
