"""Conversations brought to the form ``(s?(ua)+)?`` by the cheapest edits.

Turns are sorted by conversation and turn over range partitions and cut into pieces of at most PIECE turns. A piece is
aligned for each state of the grammar it may begin and end in (nothing yet, after system, after user, after assistant): its
turns against every feasible length of the alternating target between the two states, by the Wagner-Fischer table, whose
Ukkonen band comes from the best cost so far; of equally cheap alignments the audit that is least in ASCII stays. A piece that
holds its whole conversation has one begin and two ends. Costs and audits of pieces are then chained in order. An audit that is
least for a piece is part of the least one of the whole: equally cheap ones of a piece never begin each other, as the
longer would have more inserts.

So a conversation of any length is aligned in parallel. Only the chain of its narrow pieces and the digest of its repaired text,
which is sequential by definition, run through one task each, as streams.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PIECE = 24
#: States of the grammar: nothing yet, after system, after user, after assistant. It may end in the first and the last.
STATES, FINAL = range(4), (0, 3)
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}


def target(begin: int, end: int, length: int) -> str | None:
    """The one string of ``length`` initials that leads from a state to another without system, or None."""
    if length == 0:
        return "" if begin == end else None
    text = ("au" if begin == 2 else "ua") * (length // 2 + 1)
    return text[:length] if end == (2 if text[length - 1] == "u" else 3) else None


def align(turns: str, want: str, bound: int) -> tuple[int, str] | None:
    """(cost, least audit) of editing ``turns`` to the initials ``want`` if it costs at most ``bound``.

    A turn is its initial, upper case if truncated, ``x`` if it must go, ``o`` if its role is none of the three. Row i of the
    table holds the costs of the turns from i on; only cells within the band are filled.
    """
    n, m, none = len(turns), len(want), bound + 1
    # i - j turns more have been deleted than inserted; ahead of a cell the other way round.
    wide = lambda k: INSERT * k if k > 0 else -DELETE * k
    rows: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, below = rows[i], rows[i + 1] if i < n else {}
        for j in range(min(m, i + bound // INSERT), max(0, i - bound // DELETE) - 1, -1):
            if wide(j - i) + wide((m - j) - (n - i)) > bound:
                continue
            if i == n and j == m:
                here[j] = 0
                continue
            cost = none
            if i < n:
                cost = below.get(j, none) + DELETE
                if j < m and turns[i] != "x":
                    late = TRUNCATED if turns[i].isupper() else 0
                    step = below.get(j + 1, none) + late
                    if turns[i].lower() == want[j]:
                        cost = min(cost, step + KEEP)
                    if want[j] != "s":
                        cost = min(cost, step + REROLE)
            if j < m and want[j] != "s":
                cost = min(cost, here.get(j + 1, none) + INSERT)
            if cost <= bound:
                here[j] = cost
    if 0 not in rows[0]:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (n, m):
        cost = rows[i][j]
        if i < n and rows[i + 1].get(j, none) + DELETE == cost:
            audit.append("D")
            i += 1
            continue
        if j < m and want[j] != "s" and rows[i].get(j + 1, none) + INSERT == cost:
            audit.append("I")
            j += 1
            continue
        late = TRUNCATED if turns[i].isupper() else 0
        same = turns[i].lower() == want[j] and rows[i + 1].get(j + 1, none) + late + KEEP == cost
        audit.append("K" if same else "R")
        i, j = i + 1, j + 1
    return rows[0][0], "".join(audit)


@lru_cache(maxsize=1 << 16)
def best(turns: str, begin: int, end: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of a piece that lead from ``begin`` to ``end``; ties to the least audit."""
    n, gone = len(turns), turns.count("x")
    # Deleting all and inserting the shortest target is always open, unless the target needs a kept system turn.
    found: tuple[int, str] | None = None
    for head in ("", "s") if begin == 0 else ("",):
        if head and end == 0:
            continue
        floor = lambda length: DELETE * gone + (
            INSERT * (length - n + gone) if length > n - gone else DELETE * (n - gone - length))
        for length in sorted(range(len(head), n + DELETE * n // INSERT + 4), key=lambda k: (floor(k), k)):
            want = target(1 if head else begin, end, length - len(head))
            limit = found[0] if found else DELETE * n + INSERT * (length + 2) + TRUNCATED * n
            if want is None or floor(length) > limit:
                continue
            got = align(turns, head + want, limit)
            if got and (found is None or got < found):
                found = got
    return found


WAYS = T.ArrayType(T.StructType([
    T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
WAYS_ARROW = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
PIECES = [
    ("part", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("ways", WAYS_ARROW),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
PIECES_SQL = ("part bigint, piece bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, "
              "last_role string, first_turn bigint, last_turn bigint, turns bigint")

NOT_BLANK, OPEN_END = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\Z")


class Piece:
    """Figures of a piece while its turns come in."""

    def __init__(self):
        self.roles, self.texts, self.code, self.seen = [], [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None

    def add(self, turn, role, text, again: bool) -> None:
        initial = role[:1]
        if self.roles and self.roles[-1][:1] + initial not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        letter = initial if initial in ("s", "u", "a") else "o"
        if not NOT_BLANK.search(text):
            self.blank += 1
            letter = "x"
        elif again:
            self.duplicate += 1
            letter = "x"
        elif OPEN_END.search(text):
            self.truncated += 1
            letter = letter.upper()
        self.roles.append(role)
        self.texts.append(text)
        self.code.append(letter)

    def row(self, part: int, piece: int, opens: bool, closes: bool) -> tuple:
        code, ways = "".join(self.code), []
        for begin in (0,) if opens else STATES:
            for end in FINAL if closes else STATES:
                if way := best(code, begin, end):
                    ways.append({"begin": begin, "end": end, "cost": way[0], "audit": way[1]})
        return (
            part, piece, len(code), self.blank, self.duplicate, self.truncated, self.illegal,
            self.roles[0][:1] if code else None, self.roles[-1][:1] if code else None,
            self.first_turn, self.last_turn, self.turns, ways, self.roles, self.texts)


def _batch(conv: pa.DataType, rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate([("conv", conv), *columns])], ["conv", *[c for c, _ in columns]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to pieces. The first and last piece of a partition may belong to a conversation that goes on in another."""
    part, number, rows, size = TaskContext.get().partitionId(), 0, [], 0
    piece, conv, opens, kind = None, None, False, pa.null()
    for batch in batches:
        kind = batch.schema.field("conv").type
        for x in batch.to_pylist():
            if piece is None or x["conv"] != conv:
                if piece is not None:
                    rows.append((conv, *piece.row(part, number, opens, True)))
                    number += 1
                opens, conv, piece = piece is not None, x["conv"], Piece()
            for k in range(0 if x["gone"] else x["copies"]):
                if len(piece.code) == PIECE:
                    rows.append((conv, *piece.row(part, number, opens, False)))
                    number, opens, piece = number + 1, False, Piece()
                piece.add(x["turn"], x["role"], x["text"], k > 0 or not x["first"])
                size += len(x["text"])
                if len(rows) >= 2000 or size > 1 << 23 and rows:
                    yield _batch(kind, rows, PIECES)
                    rows, size = [], 0
    if piece is not None:
        rows.append((conv, *piece.row(part, number, opens, False)))
        yield _batch(kind, rows, PIECES)


REPORT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
          ("cost", pa.int64()), ("audit", pa.string())]
REPORT_SQL = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
CHOSEN = [("part", pa.int64()), ("piece", pa.int64()), *REPORT, ("offset", pa.int64()), ("head", pa.bool_())]


class Chain:
    """The pieces of a conversation, joined in order."""

    def __init__(self):
        # The audits of all states share what is in ``settled``; each state has its cost and the rest of its audit.
        self.settled, self.open = [], {0: (0, "")}
        self.pieces, self.sums = [], [0, 0, 0, 0]
        self.first = self.last = self.last_role = None
        self.turns = 0

    def add(self, x: dict) -> None:
        state: dict[int, tuple[int, str]] = {}
        for way in x["ways"]:
            if way["begin"] in self.open:
                cost, audit = self.open[way["begin"]]
                to = (cost + way["cost"], audit + way["audit"])
                if way["end"] not in state or to < state[way["end"]]:
                    state[way["end"]] = to
        same = commonprefix([a for _, a in state.values()])
        self.settled.append(same)
        self.open = {k: (c, a[len(same):]) for k, (c, a) in state.items()}
        self.pieces.append((x["part"], x["piece"], x["n"]))
        for i, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.sums[i] += x[c]
        if x["n"]:
            self.sums[3] += self.last_role is not None and self.last_role + x["first_role"] not in LEGAL
            self.last_role = x["last_role"]
        if x["first_turn"] is not None:
            self.turns += x["turns"] - (self.last == x["first_turn"])
            self.first = x["first_turn"] if self.first is None else self.first
            self.last = x["last_turn"]

    def rows(self, conv) -> Iterator[tuple]:
        """The report of the conversation, then the audit of each piece, with the number of turns before it."""
        cost, rest = min(self.open[k] for k in FINAL if k in self.open)
        audit = "".join(self.settled) + rest
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        yield conv, -1, -1, gaps, *self.sums, cost, audit, None, None
        head = (len(audit) - audit.count("D")) % 2 == 1
        at = offset = 0
        for i, (part, piece, n) in enumerate(self.pieces):
            end = at
            for _ in range(n):
                while audit[end] == "I":
                    end += 1
                end += 1
            end = len(audit) if i == len(self.pieces) - 1 else end
            own = audit[at:end]
            yield conv, part, piece, None, None, None, None, None, None, own, offset, head
            offset += len(own) - own.count("D")
            at = end


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and order to reports and chosen audits."""
    chain, conv, kind, rows, size = None, None, None, [], 0
    for batch in batches:
        kind = batch.schema.field("conv").type
        for x in batch.to_pylist():
            if chain is None or x["conv"] != conv:
                for row in chain.rows(conv) if chain else ():
                    rows.append(row)
                    size += len(row[9])
                    if len(rows) >= 5000 or size > 1 << 23:
                        yield _batch(kind, rows, CHOSEN)
                        rows, size = [], 0
                chain, conv = Chain(), x["conv"]
            chain.add(x)
    for row in chain.rows(conv) if chain else ():
        rows.append(row)
        if len(rows) >= 5000:
            yield _batch(kind, rows, CHOSEN)
            rows = []
    if rows:
        yield _batch(kind, rows, CHOSEN)


def edited(audit: str, offset: int, head: bool, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that a piece has after its audit; ``offset`` turns stand before it."""
    i = 0
    for op in audit:
        wanted = "ua"[(offset - head) % 2]
        if op == "I":
            yield ROLES[wanted], ""
        elif op == "K":
            yield roles[i], texts[i]
        elif op == "R":
            yield ROLES[wanted], texts[i]
        i += op != "I"
        offset += op != "D"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports, audits and pieces, sorted; one row per conversation."""
    columns = [*REPORT, ("repaired_sha256", pa.string())]
    report, sha, chosen, conv, kind, rows, size, begun = None, None, None, None, None, [], 0, False
    for batch in batches:
        kind = batch.schema.field("conv").type
        for x in batch.to_pylist():
            if x["part"] < 0:
                if report is not None:
                    rows.append((conv, *report, sha.hexdigest()))
                    size += len(report[-1])
                    if len(rows) >= 5000 or size > 1 << 23:
                        yield _batch(kind, rows, columns)
                        rows, size = [], 0
                conv, report, sha, begun = x["conv"], [x[c] for c, _ in REPORT], hashlib.sha256(), False
            elif x["roles"] is None:
                chosen = x
            else:
                for role, text in edited(chosen["audit"], chosen["offset"], chosen["head"], x["roles"], x["texts"]):
                    sha.update((("\n" if begun else "") + role + ":" + text).encode())
                    begun = True
    if report is not None:
        rows.append((conv, *report, sha.hexdigest()))
        yield _batch(kind, rows, columns)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (x["conv"], x["offset"] + i, role, text)
            for x in batch.to_pylist()
            for i, (role, text) in enumerate(edited(x["audit"], x["offset"], x["head"], x["roles"], x["texts"]))]
        yield _batch(batch.schema.field("conv").type, rows, [("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def aligned(turns: DataFrame, gone: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces, chosen): the pieces of all conversations with their turns, and reports and audits, by (conv, part, piece)."""
    space = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
        F.coalesce(F.col(gone), F.lit(False)).alias("gone") if gone else F.lit(False).alias("gone"))
    blank = {c: F.when(F.col("gone"), F.lit("")).otherwise(F.col(c)) for c in ("role", "text")}
    # Rows of a conversation that are equal, or gone, are one row with a count from here on.
    rows = (
        rows.withColumns(blank | {"turn": F.when(~F.col("gone"), F.col("turn"))})
        .groupBy("conv", "turn", "role", "text", "gone").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
        .withColumn("when", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    )
    firsts = (
        rows.filter(~F.col("gone")).groupBy("conv", "said").agg(F.min("when").alias("earliest"))
        .select(F.col("conv").alias("conv2"), F.col("said").alias("said2"), "earliest"))
    ordered = (
        rows.join(firsts, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("said") == F.col("said2")), "left")
        .select("conv", "turn", "role", "text", "gone", "copies", F.coalesce(F.col("when") == F.col("earliest"), F.lit(True)).alias("first"))
        .repartitionByRange("conv", F.col("gone").desc(), "turn", "role", "text")
        .sortWithinPartitions("conv", F.col("gone").desc(), "turn", "role", "text")
    )
    conv = turns.schema["conv_id"].dataType
    fields = [*T._parse_datatype_string(PIECES_SQL).fields, T.StructField("ways", WAYS),
              *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("roles", "texts")]]
    pieces = written(ordered.mapInArrow(_cut, T.StructType([T.StructField("conv", conv), *fields])), "conversation-pieces")
    chosen = written(
        pieces.drop("roles", "texts").repartition("conv").sortWithinPartitions("conv", "part", "piece")
        .mapInArrow(_chain, T.StructType([
            T.StructField("conv", conv), *T._parse_datatype_string(f"part bigint, piece bigint, {REPORT_SQL}, offset bigint, head boolean").fields])),
        "conversation-audits")
    return pieces, chosen


def repair_conversations(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256 (of ``role:text`` of the repaired turns, joined by newlines).

    Turns count by turn, nulls first, then role and text; equal rows follow each other. Null roles and texts are one space. Rows
    whose column ``gone`` is true stand for their conversation only; one that has no other rows gets zeros, an empty audit and
    the digest of nothing. A null conv_id is a conversation of its own. Further columns of ``turns`` are not looked at, whatever
    their names. An empty table gives an empty one.
    """
    pieces, chosen = aligned(turns, gone)
    empty = T.ArrayType(T.StringType())
    both = chosen.select(
        "conv", "part", "piece", F.lit(0).alias("step"), *[c for c, _ in REPORT], "offset", "head",
        F.lit(None).cast(empty).alias("roles"), F.lit(None).cast(empty).alias("texts"),
    ).unionByName(pieces.select("conv", "part", "piece", F.lit(1).alias("step"), "roles", "texts"), allowMissingColumns=True)
    schema = T.StructType([
        T.StructField("conv", turns.schema["conv_id"].dataType), *T._parse_datatype_string(f"{REPORT_SQL}, repaired_sha256 string").fields])
    return (
        both.repartition("conv").sortWithinPartitions("conv", "part", "piece", "step").mapInArrow(_digest, schema)
        .withColumnRenamed("conv", "conv_id"))


def repaired_turns(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, position, role, text) of the repaired conversations, positions from 0."""
    pieces, chosen = aligned(turns, gone)
    picked = chosen.filter("part >= 0").select(
        F.col("part").alias("part2"), F.col("piece").alias("piece2"), "audit", "offset", "head")
    schema = T.StructType([
        T.StructField("conv", turns.schema["conv_id"].dataType), *T._parse_datatype_string("position bigint, role string, text string").fields])
    return (
        pieces.join(picked, (F.col("part") == F.col("part2")) & (F.col("piece") == F.col("piece2")))
        .select("conv", "audit", "offset", "head", "roles", "texts").mapInArrow(_edit, schema).withColumnRenamed("conv", "conv_id"))
