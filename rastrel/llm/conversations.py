"""Repair of conversation structure with the fewest edits, by Hirschberg's divide and conquer.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant turns. Reading it from the left
there are four states: nothing yet, after system, after user, after assistant. Costs up to the middle row are kept as one vector of four
(forward), costs from there to the end as another (backward); where their sum is least the best path crosses the middle, and both
halves are solved in the same way. So the costs take constant space, and only the edits are kept.

Among edits of equal cost those whose initials come first in ASCII win. Inserted turns are counted to the row before which they stand, so
the edits of a row end with a letter that is no insertion, and no beginning of an optimal path is the beginning of another one's. Hence
beginnings can be compared state by state: with each forward vector goes the order of the four best beginnings, and of several optimal
crossings the one with the first beginning is right. Vectors relative to their least entry take few values, so a step is one look-up.

A row enters this as one byte (its role's initial and its fault). The texts pass once, in order and as a stream, through the SHA-256 of
the repaired conversation; that hash is what keeps the rows of one conversation in one task, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of a changed role, a deletion, an insertion and an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED_LEFT = 3, 4, 3, 3
#: Roles of the states, and the state that follows when a turn is inserted or given a new role.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: A row as a byte: the role's initial, plus 4 for blank or duplicate (must go), or plus 8 for truncated. The last byte is the end.
INITIALS = "sua"
OTHER, MUST_GO, TRUNCATED, END = 3, 4, 8, 16
INF = 1 << 40

Vector = tuple[int, int, int, int]


@cache
def step(symbol: int, state: int) -> dict[int, tuple[int, str]]:
    """The states after a row: the least cost and, of equal ones, the first letters, insertions before the row included."""
    out: dict[int, tuple[int, str]] = {}

    def add(to: int, cost: int, letters: str) -> None:
        if to not in out or (cost, letters) < out[to]:
            out[to] = (cost, letters)

    cost, letters = 0, ""
    for _ in range(3):  # two insertions reach every state that insertions can reach
        if symbol == END:
            if state in (START, ASSISTANT):
                add(START, cost, letters)
        else:
            add(state, cost + DELETE, letters + "D")
            if not symbol & MUST_GO:
                left = TRUNCATED_LEFT if symbol & TRUNCATED else 0
                role = symbol & 3
                add(NEXT[state], cost + REROLE + left, letters + "R")
                if role == 0 and state == START:
                    add(SYSTEM, cost + left, letters + "K")
                elif role != OTHER and role != 0 and NEXT[state] == (USER if role == 1 else ASSISTANT):
                    add(NEXT[state], cost + left, letters + "K")
        state, cost, letters = NEXT[state], cost + INSERT, letters + "I"
    return out


@cache
def forward(costs: Vector, order: Vector, symbol: int) -> tuple[int, Vector, Vector]:
    """The vector after a row, relative to its least entry, and the order of the best beginnings of each state."""
    best: list[tuple[int, int, str] | None] = [None] * 4
    for state in range(4):
        if costs[state] < INF:
            for to, (cost, letters) in step(symbol, state).items():
                new = (costs[state] + cost, order[state], letters)
                if best[to] is None or new < best[to]:
                    best[to] = new
    least = min(b[0] for b in best if b)
    places = sorted(b[1:] for b in best if b)
    return least, tuple(b[0] - least if b else INF for b in best), tuple(places.index(b[1:]) if b else 9 for b in best)


@cache
def backward(costs: Vector, symbol: int) -> tuple[int, Vector]:
    """The least costs from each state before a row to the end, relative to the least."""
    new = [min((cost + costs[to] for to, (cost, _) in step(symbol, state).items()), default=INF) for state in range(4)]
    least = min(new)
    return least, tuple(min(c - least, INF) for c in new)


def only(state: int) -> Vector:
    return tuple(0 if k == state else INF for k in range(4))


def cheapest(symbols: bytes) -> tuple[int, str]:
    """Least cost and the first of the cheapest edits' initials, for the rows of a conversation in order."""
    rows = symbols + bytes([END])
    out: list[str] = []
    total = 0
    todo = [(0, len(rows), START, START)]
    while todo:
        low, high, begin, end = todo.pop()
        if high - low == 1:
            cost, letters = step(rows[low], begin)[end]
            total += cost
            out.append(letters)
            continue
        middle = (low + high) // 2
        costs, order = only(begin), only(begin)
        for k in range(low, middle):
            _, costs, order = forward(costs, order, rows[k])
        rest = only(end)
        for k in range(high - 1, middle - 1, -1):
            _, rest = backward(rest, rows[k])
        cross = min(range(4), key=lambda q: (costs[q] + rest[q], order[q]))
        todo += [(middle, high, cross, end), (low, middle, begin, cross)]
    return total, "".join(out)


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` after the stated damage; nulls of role and text become a blank, conv_id and turn stay as they are.

    A row that is repeated stands twice. Further columns are dropped.
    """
    blank = F.lit(" ")
    kind = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")), F.lit(20))
    text = F.coalesce("text", blank)
    role = F.coalesce("role", blank)
    return rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _symbol(role: Column, text: Column) -> Column:
    initial = F.substring(role, 1, 1)
    number = F.coalesce(*[F.when(initial == c, F.lit(k)) for k, c in enumerate(INITIALS)], F.lit(OTHER))
    full = F.regexp_replace(text, r"[\x20\x09-\x0D]+$", "")
    return number + F.when(full == "", F.lit(MUST_GO)).when(~F.substring(full, -1, 1).isin(".", "!", "?"), F.lit(TRUNCATED)).otherwise(F.lit(0))


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What has been read of one conversation: first its rows as symbols, then their texts."""

    def __init__(self):
        self.symbols, self.counts, self.audit = bytearray(), dict.fromkeys(FIELDS, 0), None
        self.before, self.low, self.turns, self.last_turn, self.initial = None, None, 0, None, None
        self.hash, self.first, self.state, self.at = hashlib.sha256(), True, START, 0

    def light(self, symbol: int, early: bool, same: bool, turn) -> None:
        if not symbol & MUST_GO and (same or not early):
            self.counts["duplicate"] += 1
            symbol = symbol & 3 | MUST_GO
        elif symbol & MUST_GO:
            self.counts["blank"] += 1
        elif symbol & TRUNCATED:
            self.counts["truncated"] += 1
        role = symbol & 3
        if self.initial is not None and (self.initial, role) not in ((0, 1), (1, 2), (2, 1)):
            self.counts["illegal"] += 1
        self.initial = role
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.symbols.append(symbol)

    def settle(self) -> None:
        if self.audit is None:
            self.counts["cost"], self.audit = cheapest(bytes(self.symbols)) if self.symbols else (0, "")
            if self.turns:
                self.counts["gaps"] = self.last_turn - self.low + 1 - self.turns

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def heavy(self, role: str | None, text: str | None) -> None:
        """The next row (None: the end): the insertions before it, then its own letter."""
        self.settle()
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.add(NAMES[self.state], "")
            self.at += 1
        if role is not None:
            letter = self.audit[self.at]
            self.at += 1
            if letter != "D":
                self.state = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[self.state]
                self.add(role if letter == "K" else NAMES[self.state], text)

    def row(self) -> tuple:
        self.heavy(None, None)
        return (*[self.counts[f] for f in FIELDS], self.audit, self.hash.hexdigest())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation: kind 0 (it exists), kind 1 (light) in order, kind 2 (with text) in order."""
    key, now, out, light = None, None, [], None

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        names = ["conv_id", *FIELDS, "audit", "repaired_sha256"]
        return pa.record_batch([pa.array([None if k is None else k[0] for k in columns[0]], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.string()) for c in columns[7:]]], names=names)

    kind_of_id = pa.int64()
    for batch in batches:
        kind_of_id = batch.schema.field("conv_id").type
        for ids, kind, turn, role, digest, symbol, early, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key is None or key != (ids,):
                if key is not None:
                    out.append((key, *now.row()))
                key, now, light = (ids,), _Conversation(), None
            if kind == 1:
                now.light(symbol, early, light == (turn, role, digest), turn)
                light = (turn, role, digest)
            elif kind == 2:
                now.heavy(role, text)
        if len(out) >= 10_000:
            yield flush(kind_of_id)
            out = []
    if key is not None:
        out.append((key, *now.row()))
    if out:
        yield flush(kind_of_id)


def repair(damaged: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit and repaired_sha256 for every distinct conv_id of ``ids``.

    ``damaged`` has conv_id, turn, role and text, without nulls in the last two. Rows go by turn, nulls first, then by role and
    by the text's SHA-256; a null conv_id is a conversation of its own. A conversation without rows gets zeros, no edits and the hash of the
    empty string. Repeated rows are duplicates of the first. A row with an empty
    role or another initial can't be kept as it is. Empty tables give empty results. Further columns are not read.
    """
    rows = damaged.select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("t"), _symbol(F.col("role"), F.col("text")).alias("symbol"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # only lines said in several turns need a join to know the first of them; equal rows of one turn follow each other
    said = rows.groupBy("conv_id", "role", "t").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first <> last")
    said = said.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("t").alias("d"), "first")
    same = rows.conv_id.eqNullSafe(said.c) & (rows.role == said.r) & (rows.t == said.d)
    light = rows.drop("text").join(said, same, "left").withColumn("early", F.coalesce(order == F.col("first"), F.lit(True)))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("symbol", "int"), ("early", "boolean"))]
    kinds = dict(rows.dtypes)
    empty = [F.lit(None).cast(kinds[n]).alias(n) for n in ("turn", "role", "t")]
    text = F.lit(None).cast("string").alias("text")
    every = ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), *empty, *none, text)
    every = every.unionByName(light.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "t", "symbol", "early", text))
    every = every.unionByName(rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "t", *none, "text"))
    laid = every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "t")
    schema = f"conv_id {kinds['conv_id']}, " + ", ".join(f"{f} long" for f in FIELDS) + ", audit string, repaired_sha256 string"
    return laid.mapInArrow(_stream, schema)
