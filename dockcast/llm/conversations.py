"""Structure repair of conversations by a run-length dynamic programme.

Every row gets a symbol: its role initial and its fault.  Equal consecutive symbols
are one run.  A row is a min-plus matrix over the four states of the wanted pattern
``(s?(ua)+)?`` (nothing yet, after the system, after a user, after an assistant): the
cheapest way from state to state with the inserts before the row and its own edit.  A
run is that matrix to the power of its length, taken from cached binary powers, so the
costs run backward over runs, not over rows.  The edits are then unrolled forward,
again by halves of powers, each half remembered.

Rows of one turn are ordered by role, then by the md5 of the text; a null turn comes
first, a null role or text is one space.  An empty role, like any role whose initial is
not s, u or a, can't be kept.  Rows whose conversation is null are one conversation.
Repeated rows are one row with a number of copies until the texts are read.  No rows:
no conversations.  Other columns are ignored.

What is found per conversation is one string of edits and one SHA-256 over all its
texts, which only a single pass in order can give, so a conversation is one sorted
stream of one task.  Neither its rows nor its texts are held: memory is five bytes for
each run and the edits.  Duplicates are found before, keyed by text, and so is the
number of copies, which makes a hot conversation many small keys there.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"

# states: nothing yet, after s, after u, after a
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_INSERTED = (2, 2, 3, 2)
_ROLE_OF = {2: "user", 3: "assistant"}
_FINAL = (0, 2 * INSERT, INSERT, 0)  # inserts that end each state
DELETED = 0  # symbol of a row that must go; others: 1 + 2 * initial + truncated
_INITIALS = "sua"
_ROWS_DDL = "kind int, turn long, role string, mark string, text string, symbol int, copies long, fault int"

Vector = tuple[int, ...]


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of a row's own edits, by letter."""
    out = [("D", DELETE, state)]
    if symbol != DELETED:
        initial, cut = divmod(symbol - 1, 2)
        kept = _AFTER[_INITIALS[initial]][state] if initial < len(_INITIALS) else None
        if kept is not None:
            out.append(("K", KEEP + TRUNCATED * cut, kept))
        out.append(("R", REROLE + TRUNCATED * cut, _INSERTED[state]))
    return out


def _times(m: list[Vector], v: Vector) -> Vector:
    return tuple(min(a + b for a, b in zip(row, v)) for row in m)


@lru_cache(None)
def _power(symbol: int, k: int) -> list[Vector]:
    """Min-plus matrix of 2**k rows of one symbol."""
    far = 1 << 60
    if k:
        half = _power(symbol, k - 1)
        columns = list(zip(*half))
        return [tuple(min(a + b for a, b in zip(row, c)) for c in columns) for row in half]
    out = []
    for state in range(4):
        row, at, spent = [far] * 4, state, 0
        for _ in range(4):  # further inserts only come back to the same states
            for _, cost, then in _edits(symbol, at):
                row[then] = min(row[then], spent + cost)
            at, spent = _INSERTED[at], spent + INSERT
        out.append(tuple(row))
    return out


def _bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


@lru_cache(1 << 16)
def _before(symbol: int, n: int, after: Vector) -> Vector:
    """Costs before a run of ``n`` from those after it."""
    for k in reversed(_bits(n)):
        after = _times(_power(symbol, k), after)
    return after


def _split(v: Vector) -> tuple[int, Vector]:
    low = min(v)
    return low, tuple(x - low for x in v)


def _step(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """The least letters of one row, with the inserts before it."""
    before = _times(_power(symbol, 0), after)
    letters = ""
    while True:
        options = [(letter, cost + after[then], then) for letter, cost, then in _edits(symbol, state)]
        options.append(("I", INSERT + before[_INSERTED[state]], _INSERTED[state]))
        letter, _, then = min(x for x in options if x[1] == before[state])
        letters, state = letters + letter, then
        if letter != "I":
            return letters, state


def _unrolled(symbol: int, k: int, state: int, after: Vector) -> tuple[str, int]:
    if not k:
        return _step(symbol, state, after)
    half = _unroll if k <= 12 else _unrolled  # long strings aren't remembered
    middle = _split(_times(_power(symbol, k - 1), after))[1]
    first, state = half(symbol, k - 1, state, middle)
    second, state = half(symbol, k - 1, state, after)
    return first + second, state


_unroll = lru_cache(1 << 14)(_unrolled)


@lru_cache(1 << 16)
def _run(symbol: int, n: int, state: int, after: Vector) -> tuple[str, int]:
    """Edits of a run from ``state``; ``after`` are the costs after it (least 0)."""
    bits = _bits(n)
    ends = [after]
    for k in reversed(bits[1:]):
        ends.append(_split(_times(_power(symbol, k), ends[-1]))[1])
    out = []
    for k, end in zip(bits, reversed(ends)):
        letters, state = (_unroll if k <= 12 else _unrolled)(symbol, k, state, end)
        out.append(letters)
    return "".join(out), state


class Runs:
    """Run-length code of the symbols of a conversation."""

    def __init__(self):
        self.symbols, self.lengths = bytearray(), array("I")

    def add(self, symbol: int, n: int) -> None:
        while n:
            if self.symbols and self.symbols[-1] == symbol and self.lengths[-1] < 1 << 31:
                self.lengths[-1] += min(n, 1 << 31)
            else:
                self.symbols.append(symbol)
                self.lengths.append(min(n, 1 << 31))
            n -= min(n, 1 << 31)

    def best(self, part: int = 1 << 16) -> tuple[int, str]:
        """Least cost and its least edits.  Costs are kept at the ends of parts only."""
        starts = list(range(0, len(self.symbols), part))
        base, after = _split(_FINAL)
        ends = []
        for s in reversed(starts):
            ends.append(after)
            for low, after in self._back(s, min(s + part, len(self.symbols)), after):
                base += low
        cost = base + after[0]
        state, out = 0, []
        for s, end in zip(starts, reversed(ends)):
            stop = min(s + part, len(self.symbols))
            costs = [end, *(v for _, v in self._back(s, stop, end))]
            for i in range(s, stop):
                letters, state = _run(self.symbols[i], self.lengths[i], state, costs[stop - 1 - i])
                out.append(letters)
        while state not in (0, 3):
            out.append("I")
            state = _INSERTED[state]
        return cost, "".join(out)

    def _back(self, start: int, stop: int, after: Vector):
        for i in range(stop - 1, start - 1, -1):
            low, after = _split(_before(self.symbols[i], self.lengths[i], after))
            yield low, after


def _marked(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, mark (of the text), fault (1 blank, 3 truncated, else 0)."""
    blank = F.lit(" ")
    base = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"),
    )
    kept = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(kept == "", 1).when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return base.withColumns({"mark": F.md5("text"), "fault": fault})


def _initial(role: Column) -> Column:
    """0, 1, 2 for s, u, a; 3 for others."""
    first = F.left(role, F.lit(1))
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _streams(rows: DataFrame, names: DataFrame | None, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """All conversations, each with its symbols in order and then its texts in order."""
    base = _marked(rows, conv, turn, role, text)
    key = ["conv", "role", "mark"]
    alike = base.groupBy("conv", "turn", "role", "mark", "fault").agg(F.count("*").alias("copies"))
    firsts = alike.groupBy(*key).agg(F.min(F.struct("turn")).alias("first"))
    firsts = firsts.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), "first")
    joined = alike.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")))
    seen = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when((F.col("fault") != 1) & seen, 2).otherwise(F.col("fault"))
    own = F.when(fault.isin(1, 2), DELETED).otherwise(1 + 2 * _initial(F.col("role")) + (fault == 3).cast("int"))
    nothing = F.lit(None).cast("string")
    symbols = joined.select(
        "conv", F.lit(1).alias("kind"), "turn", "role", "mark", nothing.alias("text"), own.cast("int").alias("symbol"), "copies", fault.cast("int").alias("fault")
    )
    # a blank row's text is never read
    whole = F.when(F.col("fault") == 1, F.lit("")).otherwise(F.col("text"))
    none = F.lit(None).cast("int")
    texts = base.select("conv", F.lit(2).alias("kind"), "turn", "role", "mark", whole.alias("text"), none.alias("symbol"), F.lit(1).cast("long").alias("copies"), none.alias("fault"))
    out = symbols.unionByName(texts)
    if names is not None:
        only = names.select(F.col(conv).alias("conv")).distinct()
        absent = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _ROWS_DDL.split(", ")}
        out = out.unionByName(only.withColumns(absent | {"kind": F.lit(0)}).select(out.columns))
    return out.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "mark")


class _Conversation:
    """One conversation as its rows pass."""

    def __init__(self):
        self.runs, self.counts = Runs(), [0, 0, 0, 0]  # by fault
        self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.cost, self.letters, self.at, self.state = 0, None, 0, 0

    def symbol(self, turn, role: str, symbol: int, copies: int, fault: int) -> None:
        first = role[:1]
        if self.last is not None and self.last + first not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1  # two alike are never in order
        self.last = first
        self.counts[fault] += 1
        self.runs.add(symbol, 1)
        if copies > 1:  # of a blank row all copies are blank
            self.counts[1 if fault == 1 else 2] += copies - 1
            self.runs.add(DELETED, copies - 1)
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn

    def plan(self) -> None:
        if self.letters is None:
            self.cost, self.letters = self.runs.best()
            self.runs = Runs()

    def _inserts(self):
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.state = _INSERTED[self.state]
            yield _ROLE_OF[self.state], "", "I"

    def text(self, role: str, text: str):
        """What becomes of the next row: (role, text, edit), inserts before it first."""
        self.plan()
        yield from self._inserts()
        edit = self.letters[self.at]
        self.at += 1
        if edit == "K":
            self.state = _AFTER[role[0]][self.state]
            yield role, text, edit
        elif edit == "R":
            self.state = _INSERTED[self.state]
            yield _ROLE_OF[self.state], text, edit

    def rest(self):
        self.plan()
        yield from self._inserts()

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _passing(batches):
    """(conversation number, conv, event, value): 'row' with (role, text, edit), 'end' with the conversation."""
    conv, now = None, None
    for b in batches:
        convs = b.column("conv").to_pylist()
        cols = [b.column(c).to_pylist() for c in ("kind", "turn", "role", "text", "symbol", "copies", "fault")]
        for c, kind, turn, role, text, symbol, copies, fault in zip(convs, *cols):
            if now is None or c != conv:
                if now is not None:
                    yield from ((conv, "row", x) for x in now.rest())
                    yield conv, "end", now
                conv, now = c, _Conversation()
            if kind == 1:
                now.symbol(turn, role, symbol, copies, fault)
            elif kind == 2:
                yield from ((conv, "row", x) for x in now.text(role, text))
    if now is not None:
        yield from ((conv, "row", x) for x in now.rest())
        yield conv, "end", now


def _batches(rows, schema: pa.Schema, most: int):
    """Rows as Arrow batches of about ``most`` bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schemas(rows: DataFrame, conv: str, columns: list[tuple[str, str, pa.DataType]]):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[conv].dataType
    ddl = ", ".join([f"conv_id {kind.simpleString()}", *(f"{n} {t}" for n, t, _ in columns)])
    return ddl, pa.schema([("conv_id", to_arrow_type(kind)), *((n, a) for n, _, a in columns)])


def repair(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), role, text and the edit that made
    each (K kept, R other role, I inserted).  Deleted rows have none."""
    ddl, schema = _schemas(rows, conv_col, [("place", "long", pa.int64()), *((c, "string", pa.string()) for c in ("role", "text", "edit"))])

    def run(batches):
        def made():
            place = 0
            for conv, event, value in _passing(batches):
                if event == "row":
                    yield conv, place, *value
                place = place + 1 if event == "row" else 0

        return _batches(made(), schema, 4 << 20)

    return _streams(rows, None, conv_col, turn_col, role_col, text_col).mapInArrow(run, ddl)


def audit(
    rows: DataFrame, names: DataFrame | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256 (of what ``repair`` gives, as ``role:text`` lines),
    n_rows, n_repaired.  Conversations of ``names`` that have no rows get a row too."""
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    columns = [*((c, "long", pa.int64()) for c in longs), ("audit", "string", pa.string()), ("repaired_sha256", "string", pa.string())]
    ddl, schema = _schemas(rows, conv_col, [*columns, ("n_rows", "long", pa.int64()), ("n_repaired", "long", pa.int64())])

    def run(batches):
        def made():
            digest, lines = hashlib.sha256(), 0
            for conv, event, value in _passing(batches):
                if event == "row":
                    role, text, _ = value
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
                else:
                    c = value.counts
                    yield conv, value.gaps, c[1], c[2], c[3], value.illegal, value.cost, value.letters, digest.hexdigest(), sum(c), lines
                    digest, lines = hashlib.sha256(), 0

        return _batches(made(), schema, 4 << 20)

    return _streams(rows, names, conv_col, turn_col, role_col, text_col).mapInArrow(run, ddl)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn`` modulo 20 a row goes (0),
    loses its text (1) or its sentence ends (2), is repeated (3) or becomes a user's (4);
    nulls are one space."""
    word = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    draw = F.crc32(F.concat(word[0], F.lit(":"), word[1]).cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(draw == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" ")))
    times = F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.where(draw != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("__time"))
    return out.drop("__time")
