"""Repair of damaged conversations by a run-length dynamic program.

``damaged`` breaks rows in ways that a hash picks; ``repair`` finds for each conversation the
cheapest edits after which the first letters of its roles read ``(s?(ua)+)?``.

1. Rows equal in conversation, turn, role and text become one row with a count, so a row that
   is a large part of the table is no hot key. Later copies of a role and text are found by an
   aggregate (least turn of each) and a join; only what occurs at several turns is joined.
2. Rows are dealt in ranges of (conversation, turn, role, text) and sorted, so a conversation of
   any size is cut in pieces by place. In a piece, equal consecutive symbols (first letter of
   the role, fault) form runs. A symbol is a min-plus matrix over the four states that the
   roles read so far can be in; its binary powers are cached, and a run of any length moves a
   vector of costs by a few of them.
3. A conversation inside a range is finished there: costs from the back by runs, then choices
   unrolled from the front for the audit, least letter first among equally cheap ones. The first
   and the last conversation of a range may go on in another: of those, each piece gives the
   product of its runs, the products (16 numbers a piece) are chained from the back, and the
   pieces are unrolled in order in a stream that holds one piece at a time. The hash of the
   repaired text is one pass over it by definition; no other step follows a whole conversation.

Defined results. Null turns come first; rows of one turn are taken by role, then text, after
damage, in byte order. Null roles and texts count as one space, and so do null ids and turns
where the damage is picked. Rows with a null conv_id are one conversation. Equal rows are taken
one after the other: all but the first are duplicates unless blank. Roles count by their first
letter, case kept; a role without one of ``s``, ``u``, ``a`` can only be reroled or deleted. A
span of turns beyond a long gives the largest long as gaps. A conversation without rows after
damage, also one whose rows are all dropped, gives zeros, an empty audit and the hash of the
empty string. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

#: costs of the edits, and what an undeleted truncated row adds
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: bytes of role and text in one range of rows
RANGE_BYTES = 16 << 20
#: characters of a text that help to cut ranges; the order within a range is that of whole texts
CUT_CHARS = 100

_SPACE = " \t\n\x0b\f\r"
_MOST = 2**63 - 1


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the number of times each row stands after damage (0: dropped)."""
    as_text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    plain = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), pick.alias("pick")
    )
    kept = F.col("pick") != 0
    # dropped rows only say that the conversation is there
    return plain.select(
        "conv_id",
        F.when(kept, F.col("turn")).alias("turn"),
        F.when(F.col("pick") == 4, F.lit("user")).when(kept, F.col("role")).otherwise("").alias("role"),
        F.when((F.col("pick") <= 1), F.lit(""))
        .when(F.col("pick") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(~kept, 0).when(F.col("pick") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _flags(text: str = "text") -> tuple[Column, Column]:
    """Is a text blank; does it lack an end mark?"""
    end = F.rtrim(F.col(text), F.lit(_SPACE))
    return F.octet_length(end) == 0, ~F.right(end, F.lit(1)).isin(".", "!", "?")


# states: what the first letters of the roles so far read
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_FOLLOWING = (USER, USER, ASSISTANT, USER)
_NEVER = 1 << 60
Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]
#: first letter of the role ('' for others), truncated, must be deleted
Symbol = tuple[str, bool, bool]
GONE: Symbol = ("", False, True)


def times_vector(m: Matrix, v: Vector) -> Vector:
    return tuple(min(r[0] + v[0], r[1] + v[1], r[2] + v[2], r[3] + v[3], _NEVER) for r in m)


def times(a: Matrix, b: Matrix) -> Matrix:
    columns = [times_vector(a, tuple(row[k] for row in b)) for k in STATES]
    return tuple(tuple(columns[k][s] for k in STATES) for s in STATES)


IDENTITY: Matrix = tuple(tuple(0 if s == t else _NEVER for t in STATES) for s in STATES)


def _insertions() -> Matrix:
    once = tuple(tuple(min(IDENTITY[s][t], INSERT if _FOLLOWING[s] == t else _NEVER) for t in STATES) for s in STATES)
    return times(times(once, once), once)


INSERTED = _insertions()
#: cost of ending in each state, insertions included
ENDING: Vector = times_vector(INSERTED, (0, _NEVER, _NEVER, 0))


def kept_state(state: int, letter: str) -> int | None:
    """State after a row that keeps a role with this first letter."""
    if letter == "s":
        return SYSTEM if state == START else None
    following = _FOLLOWING[state]
    return following if letter == ("u" if following == USER else "a") else None


@lru_cache(None)
def power(symbol: Symbol, k: int) -> Matrix:
    """Min-plus matrix of 2^k rows of a symbol, each with any insertions before it."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    letter, truncated, gone = symbol
    rows = []
    for state in STATES:
        costs = [_NEVER] * 4
        costs[state] = DELETE
        if not gone:
            more = TRUNCATED if truncated else 0
            costs[_FOLLOWING[state]] = min(costs[_FOLLOWING[state]], REROLE + more)
            to = kept_state(state, letter)
            if to is not None:
                costs[to] = min(costs[to], more)
        rows.append(tuple(costs))
    return times(INSERTED, tuple(rows))


def before_run(symbol: Symbol, length: int, after: Vector) -> Vector:
    """Costs to the end before a run, from those after it."""
    k = 0
    while length:
        if length & 1:
            after = times_vector(power(symbol, k), after)
        length >>= 1
        k += 1
    return after


def run_matrix(symbol: Symbol, length: int) -> Matrix:
    out, k = IDENTITY, 0
    while length:
        if length & 1:
            out = times(out, power(symbol, k))
        length >>= 1
        k += 1
    return out


@lru_cache(1 << 16)
def _choice(symbol: Symbol, state: int, after: Vector) -> tuple[str, int]:
    """Least cheapest edits through one row, and the state after it; ``after`` has 0 as its least."""
    letter, truncated, gone = symbol
    more, before, letters = TRUNCATED if truncated else 0, times_vector(power(symbol, 0), after), ""
    while True:
        need, following = before[state], _FOLLOWING[state]
        if DELETE + after[state] == need:
            return letters + "D", state
        if INSERT + before[following] == need:
            letters, state = letters + "I", following
            continue
        to = kept_state(state, letter)
        if not gone and to is not None and more + after[to] == need:
            return letters + "K", to
        return letters + "R", following


def choose(symbol: Symbol, state: int, after: Vector) -> tuple[str, int]:
    least = min(after)
    return _choice(symbol, state, tuple(x - least for x in after))


def symbols(n: int, later: bool, blank: bool, truncated: bool, letter: str) -> list[tuple[Symbol, int]]:
    """Runs of ``n`` equal rows: the first may stay, all others are copies."""
    if blank or later:
        return [(GONE, n)] if n else []
    first = (letter if letter in ("s", "u", "a") else "", truncated, False)
    return [(first, 1), (GONE, n - 1)][: min(n, 2)]


def runs_of(rows: Iterable[tuple]) -> list[tuple[Symbol, int]]:
    """Equal consecutive symbols of rows (turn, n, later, blank, truncated, role, text) as runs."""
    parts = (part for row in rows for part in symbols(*row[1:5], _letter(row[5])))
    return [(symbol, sum(n for _, n in run)) for symbol, run in groupby(parts, itemgetter(0))]


def _letter(role: bytes) -> str:
    return role[:1].decode("ascii", "replace")


class Repair:
    """One conversation, piece by piece in order."""

    def __init__(self) -> None:
        self.state, self.cost, self.audit, self.hash, self.started = START, None, [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.initial = None

    def _count(self, rows: list[tuple]) -> None:
        for turn, n, later, blank, truncated, role, _ in rows:
            if not n:
                continue
            if turn is not None and turn != self.last_turn:
                self.turns, self.last_turn = self.turns + 1, turn
                self.first_turn = turn if self.first_turn is None else self.first_turn
            initial = _letter(role)
            if self.initial is not None:
                self.illegal += self.initial + initial not in ("su", "ua", "au")
            self.illegal, self.initial = self.illegal + n - 1, initial
            if blank:
                self.blank += n
            else:
                self.duplicate += n if later else n - 1
                self.truncated += 0 if later else truncated

    def _say(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.started else b"") + role + b":")
        self.hash.update(text)
        self.started = True

    def _edits(self, letters: str, row: tuple | None) -> None:
        """Carry out one row's edits from the state before them."""
        self.audit.append(letters)
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                self.state = kept_state(self.state, _letter(row[5]))
                self._say(row[5], row[6])
                continue
            self.state = _FOLLOWING[self.state]
            role = b"user" if self.state == USER else b"assistant"
            self._say(role, b"" if letter == "I" else row[6])

    def piece(self, rows: list[tuple], ends: Vector) -> None:
        """Rows of the conversation, with the costs from their end to the end of it."""
        self._count(rows)
        runs = runs_of(rows)
        after = [ends]
        for symbol, n in reversed(runs):
            after.append(before_run(symbol, n, after[-1]))
        if self.cost is None:
            self.cost = after[-1][START]
        after.reverse()
        # choices row by row: of a run of rows that may stay, the costs between its rows
        parts = ((row, part) for row in rows for part in symbols(*row[1:5], _letter(row[5])))
        for k, (symbol, group) in enumerate(groupby(parts, key=lambda x: x[1][0])):
            if symbol == GONE:
                # a deletion leaves the state, and its letter is the least: insertions wait until after the run
                self.audit.extend("D" * n for _, (_, n) in group)
                continue
            run = [row for row, _ in group]
            inner = [after[k + 1]]
            for _ in run[1:]:
                inner.append(times_vector(power(symbol, 0), inner[-1]))
            for row, costs in zip(run, reversed(inner), strict=True):
                self._edits(choose(symbol, self.state, costs)[0], row)

    def result(self) -> dict:
        while ENDING[self.state]:
            self._edits("I", None)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {
            "gaps": min(gaps, _MOST),
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
            "cost": self.cost or 0,
            "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }


_ROW = ["turn", "n", "later", "blank_text", "truncated_text", "role", "text"]
_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_ROW_SHAPE = "turn bigint, n bigint, later boolean, blank_text boolean, truncated_text boolean, role binary, text binary"


def _schema(conv: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(ddl).fields])


def _batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("text") or b"") + len(row.get("audit") or "")
        if size > 1 << 20 or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Conversations of a sorted range with their rows."""
    each = (row for b in batches for row in zip(*(b.column(name).to_pylist() for name in ["conv_id", *_ROW]), strict=True))
    for conv, rows in groupby(each, itemgetter(0)):
        yield conv, [row[1:] for row in rows]


def _ranges(schema: pa.Schema):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of the conversations inside a range; the first and the last one as pieces."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def piece(conv, rows):
            matrix = IDENTITY
            for symbol, n in runs_of(rows):
                matrix = times(matrix, run_matrix(symbol, n))
            yield {"conv_id": conv, "part": part, "seq": 0, "matrix": [x for row in matrix for x in row]}
            for k, row in enumerate(rows):
                yield {"conv_id": conv, "part": part, "seq": k + 1, **dict(zip(_ROW, row, strict=True))}

        def out():
            first, held = True, None
            for conv, rows in _conversations(batches):
                if held:
                    whole = Repair()
                    whole.piece(held[1], ENDING)
                    yield {"conv_id": held[0], **whole.result()}
                held = None
                if first:
                    first = False
                    yield from piece(conv, rows)
                else:
                    held = (conv, rows)
            if held:
                yield from piece(*held)

        yield from _batches(out(), schema)

    return finish


def _chained(table: pa.Table) -> pa.Table:
    """Costs from the end of each piece to the end of its conversation."""
    table = table.sort_by("part")
    ends, after = [], ENDING
    for flat in reversed(table.column("matrix").to_pylist()):
        ends.append(list(after))
        after = times_vector(tuple(tuple(flat[4 * s : 4 * s + 4]) for s in STATES), after)
    return table.drop_columns(["matrix"]).append_column("ends", pa.array(ends[::-1], pa.list_(pa.int64())))


def _streams(schema: pa.Schema):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations in pieces, one piece held at a time."""
        names = ["conv_id", "part", "ends", *_ROW]

        def out():
            each = (row for b in batches for row in zip(*(b.column(n).to_pylist() for n in names), strict=True))
            for conv, rows in groupby(each, itemgetter(0)):
                repair = Repair()
                for _, piece in groupby(rows, itemgetter(1)):
                    ends = tuple(next(piece)[2])
                    repair.piece([row[3:] for row in piece], ends)
                yield {"conv_id": conv, **repair.result()}

        yield from _batches(out(), schema)

    return finish


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair(rows: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, copies):

    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    spark, conv = rows.sparkSession, rows.schema["conv_id"].dataType
    blank, truncated = _flags()
    counted = staged(
        rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumns({"blank_text": blank, "truncated_text": truncated}),
        "conversation-rows",
    )
    size = counted.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 64).alias("b")).first()["b"] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // range_bytes))

    same = [F.col("conv_id"), F.col("role"), F.sha2("text", 256).alias("digest")]
    several = (
        counted.where("n > 0 and not blank_text")
        .select(*same, "turn")
        .groupBy("conv_id", "role", "digest")
        .agg(F.min(F.struct("turn")).alias("least"), F.count(F.lit(1)).alias("turns"))
        .where("turns > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least")
    )
    marked = counted.withColumn("digest", F.sha2("text", 256)).join(
        several,
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")),
        "left",
    )
    later = F.col("least").isNotNull() & ~F.col("turn").eqNullSafe(F.col("least.turn"))
    dealt = (
        marked.select("conv_id", "turn", "n", later.alias("later"), "blank_text", "truncated_text", "role", "text")
        .repartitionByRange(parts, "conv_id", "turn", "role", F.left("text", F.lit(CUT_CHARS)))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .withColumns({"role": F.col("role").cast("binary"), "text": F.col("text").cast("binary")})
    )
    both = _schema(conv, f"part int, seq bigint, matrix array<bigint>, {_ROW_SHAPE}, {_RESULT}")
    ranges = staged(dealt.mapInArrow(_ranges(_arrow(both)), both), "conversation-ranges")

    pieces = ranges.where("part is not null")
    chain = _schema(conv, "part int, ends array<bigint>")
    ends = pieces.where("seq = 0").select("conv_id", "part", "matrix").groupBy("conv_id").applyInArrow(_chained, chain)
    stream = (
        pieces.where("seq > 0")
        .select("conv_id", "part", "seq", F.lit(None).cast("array<bigint>").alias("ends"), *_ROW)
        .unionByName(ends.withColumn("seq", F.lit(0).cast("bigint")), allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "seq")
    )
    result = _schema(conv, _RESULT)
    return ranges.where("part is null").select(result.names).unionByName(stream.mapInArrow(_streams(_arrow(result)), result))
