"""Repair of damaged conversations by weighted finite-state composition.

The rows of a conversation are an input acceptor, a line of states; the edit transducer keeps,
reroles or deletes a row, or inserts one; the role grammar (s?(ua)+)? is an acceptor of four
states. Their composition is never built: from the states reached at a row, arcs are taken as
they are needed, inserts first (two at most between rows, a third one only leads back), then the
row's own. Its states come in topological order, and each keeps its least weight, which is
(cost, label string): costs add, labels append, and the lesser cost, then the ASCII-lesser
string, wins. A cost is a function of rows and labels, so of two strings of equal cost none
begins the other, and the least weight of a prefix is part of the least weight of the whole.

So the product of parts may be taken in any order, and no conversation is ever gathered:
rows are sorted over range partitions by conversation and turn, a block of rows becomes a
4 x 4 matrix of weights (from grammar state to grammar state), and a conversation's few
matrices are multiplied into its answer. Only the hash of the repaired text is sequential by its
nature: it is fed row by row, in bounded memory, once the edits are known. A duplicate is
told from the first of its kind by a marker that sorts right before the first, so no
join is needed, and rows that are equal travel as one row with a number.

Cases: a null role or text is one space, a null conv_id or turn one space in the damage's
key; rows without conv_id are one conversation. Rows of one turn are taken by role, then by
digest of role and text, repeats side by side. Roles count by their first character; an empty role
has none. Empty texts are blank. Conversations without rows after damage: zeros, an empty
audit and the hash of the empty string. Other columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block; a conversation of fewer rows is one block.
BLOCK = 1_024
SPACES = " \t\n\x0b\x0c\r"

#: The role grammar: state 0 is empty, 1 has read a system row, 2 a user row, 3 an assistant row.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1

Weight = tuple[int, str]


def best(into: dict[int, Weight], state: int, weight: Weight) -> None:
    if state not in into or weight < into[state]:
        into[state] = weight


def inserted(reached: dict[int, Weight]) -> dict[int, Weight]:
    """Arcs of the edit transducer that read no row: an inserted user or assistant row."""
    found, layer = dict(reached), reached
    for _ in range(2):
        ahead: dict[int, Weight] = {}
        for g, (cost, label) in layer.items():
            for role in ROLE:
                if role in GRAMMAR[g]:
                    best(ahead, GRAMMAR[g][role], (cost + INSERT, label + "I"))
        for g, w in ahead.items():
            best(found, g, w)
        layer = ahead
    return found


def edits(row: str) -> Iterator[tuple[str, str, int]]:
    """Arcs that read a row (its initial and a fault: g gone, c cut, - none): label, role initial written, cost."""
    initial, fault = row[:-1], row[-1]
    yield "D", "", DELETE
    if fault != "g":
        more = CUT if fault == "c" else 0
        yield "K", initial, KEEP + more
        for role in ROLE:
            yield "R", role, REROLE + more


def passed(reached: dict[int, Weight], row: str) -> dict[int, Weight]:
    """The states reached behind one more row."""
    found: dict[int, Weight] = {}
    for g, (cost, label) in inserted(reached).items():
        for edit, role, more in edits(row):
            ahead = g if edit == "D" else GRAMMAR[g].get(role)
            if ahead is not None:
                best(found, ahead, (cost + more, label + edit))
    return found


def matrix(rows: tuple[str, ...], starts: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs (-1: no way) and labels from each start to each grammar state."""
    costs, labels = [], []
    for start in starts:
        reached: dict[int, Weight] = {start: (0, "")}
        for row in rows:
            reached = passed(reached, row)
        costs += [reached[g][0] if g in reached else -1 for g in range(4)]
        labels += [reached[g][1] if g in reached else "" for g in range(4)]
    return tuple(costs), tuple(labels)


#: Most conversations are short and much alike.
remembered = lru_cache(1 << 14)(matrix)


class Product:
    """The least weights of a conversation so far, block by block; what all ways share is set aside."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.reached: dict[int, Weight] = {0: (0, "")}

    def times(self, costs: list[int], labels: list[str]) -> None:
        ahead: dict[int, Weight] = {}
        for g, (cost, label) in self.reached.items():
            for to in range(4):
                if costs[4 * g + to] >= 0:
                    best(ahead, to, (cost + costs[4 * g + to], label + labels[4 * g + to]))
        shared = len(commonprefix([label for _, label in ahead.values()]))
        self.done.append(next(iter(ahead.values()))[1][:shared])
        self.reached = {g: (cost, label[shared:]) for g, (cost, label) in ahead.items()}

    def least(self) -> Weight:
        cost, label = min(w for g, w in inserted(self.reached).items() if g in FINAL)
        return cost, "".join(self.done) + label


def product(parts: Iterable[tuple[list[int], list[str]]]) -> Weight:
    """The least weight of a whole conversation from its blocks' matrices."""
    whole = Product()
    for costs, labels in parts:
        whole.times(costs, labels)
    return whole.least()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times (0 for a row that is dropped, 2 for one that is repeated)."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    at = rows.select(conv.alias("conv_id"), turn.alias("turn"), blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1)
    return at.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


def digested(rows: DataFrame) -> DataFrame:
    """rows with `same`, equal for rows of equal role and text."""
    return rows.withColumn("same", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def fault(text: Column) -> Column:
    """g (blank), c (truncated) or -."""
    shown = F.rtrim(text, F.lit(SPACES))
    return F.when(shown == "", "g").when(F.right(shown, F.lit(1)).isin(".", "!", "?"), "-").otherwise("c")


ORDER = ["turn", "role", "same"]
SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("same", pa.binary()), ("block", pa.int64()), ("n", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())),
])
SEGMENTS = (
    "conv_id long, turn long, role string, same binary, block long, n long, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first_turn long, last_turn long, first string, last string, costs array<long>, labels array<string>"
)


class _Block:
    """A run of a conversation's rows in order."""

    def __init__(self, conv: int | None, at: tuple, number: int, starts: tuple[int, ...]) -> None:
        self.conv, self.at, self.number, self.starts, self.rows = conv, at, number, starts, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn: int | None, initial: str, kind: str, repeats: bool) -> None:
        if self.rows:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        if turn is not None and (turn != self.last_turn or not self.turns):
            self.turns += 1
            self.first_turn, self.last_turn = turn if self.turns == 1 else self.first_turn, turn
        self.blank += kind == "g"
        self.duplicate += kind != "g" and repeats
        self.truncated += kind == "c" and not repeats
        self.rows.append(initial + ("g" if repeats else kind))

    def row(self) -> tuple:
        costs, labels = (remembered if len(self.rows) <= 16 else matrix)(tuple(self.rows), self.starts)
        return (self.conv, *self.at, self.number, len(self.rows), self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first_turn, self.last_turn, self.first, self.last, costs, labels)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _blocks(size: int):  # noqa: ANN202
    """Blocks of the conversations in a sorted partition; a partition's first one may have begun before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, opened, marked, number = None, 0, None, 0
        for batch in batches:
            out = []
            for conv, turn, role, same, times, kind, marker in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = (turn, role, same)
                if block is None or block.conv != conv:
                    if block is not None:
                        out.append(block.row())
                    block, number, marked = _Block(conv, at, 0, (0,) if opened else (0, 1, 2, 3)), 0, None
                    opened += 1
                if marker:
                    marked = at
                    continue
                for k in range(times):
                    if len(block.rows) == size:
                        out.append(block.row())
                        number += 1
                        block = _Block(conv, at, number, (0, 1, 2, 3))
                    block.add(turn, role[:1], kind, k > 0 or marked != at)
                    if len(out) >= 1_000:
                        yield _batch(out, SEGMENT)
                        out = []
            yield _batch(out, SEGMENT)
        if block is not None:
            yield _batch([block.row()], SEGMENT)

    return run


AUDIT = pa.schema([*[(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Whole:
    """A conversation from its blocks in order, each let go once it is added; what grows is the audit alone."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.ways, self.counts, self.turns = conv, Product(), [0, 0, 0, 0], 0
        self.last = self.first_turn = self.last_turn = None

    def add(self, row: tuple) -> None:
        _, _, _, _, _, n, *counts, turns, first_turn, last_turn, first, last, costs, labels = row
        if not n:
            return
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if self.last is not None:
            self.counts[3] += self.last + first not in LEGAL
        self.last = last
        if first_turn is not None:
            self.turns += turns - (self.last_turn == first_turn)
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.last_turn = last_turn
        self.ways.times(costs, labels)

    def row(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (self.conv, gaps, *self.counts, *self.ways.least())


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their blocks, sorted."""
    whole: _Whole | None = None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if whole is None or whole.conv != row[0]:
                if whole is not None:
                    out.append(whole.row())
                whole = _Whole(row[0])
            whole.add(row)
        yield _batch(out, AUDIT)
    if whole is not None:
        yield _batch([whole.row()], AUDIT)


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """AUDITS of damaged rows: faults, and the cheapest edits."""
    told = digested(rows).select("conv_id", *ORDER, "times", fault(F.col("text")).alias("kind"))
    cells = told.groupBy("conv_id", *ORDER).agg(F.sum("times").alias("times"), F.min("kind").alias("kind"))
    seen = told.where("times > 0").groupBy("conv_id", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("timed"), "turn", "role")).alias("at"))
    marks = seen.select("conv_id", "at.turn", "at.role", "same", F.lit(0).cast("long").alias("times"), F.lit("-").alias("kind"), F.lit(True).alias("marker"))
    lined = cells.withColumn("marker", F.lit(False)).unionByName(marks).repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER, F.desc("marker"))
    parts = lined.mapInArrow(_blocks(block), SEGMENTS)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "block").mapInArrow(_answers, AUDITS)


REPAIRED = pa.schema([*AUDIT, ("repaired_sha256", pa.string())])


class Repair:
    """Rows of one conversation in order under its audit: the repaired role and text of each that stays."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _wanted(self) -> str:
        return "a" if self.state == 2 else "u"

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            role = self._wanted()
            self.at, self.state = self.at + 1, GRAMMAR[self.state][role]
            yield ROLE[role], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            initial = role[:1] if edit == "K" else self._wanted()
            self.state = GRAMMAR[self.state][initial]
            yield role if edit == "K" else ROLE[initial], text


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audited conversations with the hash of their repaired text; sorted, each audit before its rows."""
    head, repair, digest, started = None, None, None, False

    def feed(rows: Iterable[tuple[str, str]]) -> None:
        nonlocal started
        for role, text in rows:
            digest.update((("\n" if started else "") + role + ":" + text).encode())
            started = True

    def closed() -> tuple:
        feed(repair.inserts())
        return (*head, digest.hexdigest())

    for batch in batches:
        out = []
        for *numbers, role, text, times in zip(*(batch.column(c).to_pylist() for c in [*AUDIT.names, "role", "text", "times"]), strict=True):
            if times is None:
                if head is not None:
                    out.append(closed())
                head, repair, digest, started = numbers, Repair(numbers[-1]), hashlib.sha256(), False
            else:
                for _ in range(times):
                    feed(repair.row(role, text))
        yield _batch(out, REPAIRED)
    if head is not None:
        yield _batch([closed()], REPAIRED)


def repaired(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage."""
    rows = damaged(conversations)
    texts = digested(rows.where("times > 0")).select("conv_id", *ORDER, "text", "times")
    both = audits(rows, block).unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("times").isNotNull(), *ORDER)
    return dealt.mapInArrow(_repaired, AUDITS + ", repaired_sha256 string")


def mended(conversations: DataFrame) -> DataFrame:
    """conv_id, position, role, text: conversations as they are, without damage, repaired row by row."""
    plain = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(1).alias("times"),
    )
    texts = digested(plain).select("conv_id", *ORDER, "text", "times")
    both = audits(plain).unionByName(texts, allowMissingColumns=True)
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, position = None, None, 0
        for batch in batches:
            out = []

            def feed(rows: Iterable[tuple[str, str]]) -> None:
                nonlocal position
                for role, text in rows:
                    out.append((conv, position, role, text))  # noqa: B023
                    position += 1

            for id_, audit, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "times")), strict=True):
                if times is None:
                    if repair is not None:
                        feed(repair.inserts())
                    conv, repair, position = id_, Repair(audit), 0
                else:
                    feed(repair.row(role, text))
            yield _batch(out, schema)
        if repair is not None:
            yield _batch([(conv, position + k, role, text) for k, (role, text) in enumerate(repair.inserts())], schema)

    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("times").isNotNull(), *ORDER)
    return dealt.mapInArrow(run, "conv_id long, position long, role string, text string")
