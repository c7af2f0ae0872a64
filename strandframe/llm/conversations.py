"""Repair of conversations: the cheapest edits that make the roles alternate, by a dynamic program over the turns that stay.

A turn that stays is kept or reroled; all others are deleted. From one that stays to the next, the deletions between them cost the
difference of two prefix sums, and what must be inserted is known from the pair of their roles. Going from the end, a running
minimum for each role (and for none yet) holds the cheapest way on, so a turn is priced against four numbers, not against all turns
after it. Of equally cheap ways the one whose audit, the edits' initials in order, is least in ASCII is taken: a later turn before an
earlier one (deletions come first), then an insertion, a keep, a rerole.

Roles that a repaired conversation may have, by their initials: nothing, or an optional s followed by ua once or more. Keep costs 0, Rerole
(to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2; a truncated turn that stays costs 1 more. Each turn's first
fault counts: blank (nothing but white space), duplicate (its role and text were seen earlier in the conversation), truncated (its last
character that isn't white space is none of . ! ?). Blank and duplicate turns are deleted.

No group is gathered: turns are sorted by conversation over all partitions, so a long conversation lies in several; its pieces of at
most CHUNK turns, a byte a turn, are priced apart (a matrix from each role to each) and joined by their matrices. Only the last step,
which makes one audit and one hash of a conversation, streams a conversation through one task, and keeps no more of it than a piece.

Null roles and texts count as one space. Turns go by turn number, null first; equal ones by role, the text's first 64 characters, its MD5.
Equal rows count each. A null conv_id is a conversation of its own. A text is told by its SHA-256 when duplicates are sought, and a long
one is one row in a worker's memory. Empty tables give no rows; only the columns named are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, partitions, small_batches

#: Turns of a piece at most, as a power of two.
CHUNK = 16
SPACE = " \t\n\x0b\x0c\r"
#: Roles in the order of their codes, and what the code of a fault is; a turn's code is its role's plus four times its fault's.
ROLES = ("system", "user", "assistant")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: What is known before a turn: no role yet, or the initial of the last turn that stays.
NONE, S, U, A = 0, 1, 2, 3
#: Insertions between what is known and the next turn's role (s, u, a), None where no insertion helps.
GAP = {NONE: (0, 0, 1), S: (None, 0, 1), U: (None, 1, 0), A: (None, 0, 1)}
#: Cost of ending after each, by insertions of what completes a pair.
END = (0, 4, 2, 0)
DELETE, INSERT, REROLE = 3, 2, 2
FAR = 1 << 60


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of conv_id:turn modulo 20, nulls as one space: turns dropped, emptied, cut, repeated or reroled."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.select("conv_id", "turn", "role", "text", fate.alias("fate")).where("fate != 0")
    return kept.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@lru_cache(maxsize=1 << 16)
def plan(codes: bytes, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[bytes, ...]]:
    """For each of what may be known before a piece: the cost of it and all after it, and each turn's move if that is known when the turn comes.

    after is the cost of what follows the piece by what is known then. A move is 0 for a deletion, else the role's code plus one, plus 4 if it is
    reroled, plus 8 if a turn is inserted before it.
    """
    n = len(codes)
    least = [n * DELETE + x for x in after]  # with the prefix sum of deletions up to where the way goes on
    moves = [bytearray(n) for _ in after]
    for j in range(n - 1, -1, -1):
        own, fault = codes[j] & 3, codes[j] >> 2
        if fault in (BLANK, DUPLICATE):
            continue
        before, more = j * DELETE, int(fault == TRUNCATED)
        rest = [x - (j + 1) * DELETE for x in least]
        for known, gaps in GAP.items():
            best = None
            for role in range(3):
                if gaps[role] is None or role != own and role == 0:
                    continue
                ways = before + gaps[role] * INSERT + (role != own) * REROLE + more + rest[role + 1]
                if rest[role + 1] < FAR // 2 and (best is None or (ways, -gaps[role], role != own) < best[:3]):
                    best = (ways, -gaps[role], role != own, role)
            if best and best[0] < least[known]:
                least[known] = best[0]
                moves[known][j] = best[3] + 1 + 4 * best[2] + 8 * -best[1]
    return tuple(least), tuple(map(bytes, moves))


def trace(moves: tuple[bytes, ...], known: int) -> tuple[bytes, int]:
    """Each turn's move from what is known before a piece, and what is known after it."""
    out = bytearray(len(moves[0]))
    for j in range(len(out)):
        if m := moves[known][j]:
            out[j], known = m, m & 3
    return bytes(out), known


def matrix(codes: bytes) -> list[int]:
    """Least cost of a piece from each of what may be known before it to each of what may be known after it."""
    to = [plan(codes, tuple(0 if i == known else FAR for i in range(4)))[0] for known in range(4)]
    return [to[after][before] for before in range(4) for after in range(4)]


def _turns(rows: DataFrame) -> DataFrame:
    """All turns in order, `at` rising through the conversations, with their roles' and faults' codes but for duplicates."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.md5("text"), "row"]
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(ends == "", BLANK).when(~F.substring(ends, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    sorted_ = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(sorted_.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"), (code + 4 * fault).cast("int").alias("code")), "turns")


def _pieces(turns: DataFrame) -> DataFrame:
    """conv_id, first, codes, edge: a conversation's turns of one chunk, a byte each; edge if it may go on in another chunk."""
    first = turns.where(F.shiftright("code", 2) != BLANK).groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("at"))
    seen = turns.select("conv_id", "at", "code").join(first.select("at", F.lit(True).alias("first")), "at", "left")
    again = F.col("first").isNull() & (F.shiftright("code", 2) != BLANK)
    codes = seen.select("conv_id", "at", F.when(again, F.col("code").bitwiseAND(3) + 4 * DUPLICATE).otherwise(F.col("code")).alias("code"), F.shiftright("at", CHUNK).alias("chunk"))
    kind = codes.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = chunk = None
        first, piece, done, edge = 0, bytearray(), [], True
        of = None
        for batch in batches:
            of = batch.column(0).type
            for c, at, code, k in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if piece and (k != chunk or c != conv):
                    done.append((conv, first, bytes(piece), edge or k != chunk))
                    piece, edge = bytearray(), k != chunk
                if not piece:
                    conv, chunk, first = c, k, at
                piece.append(code)
            if len(done) >= 1000:
                yield table(done, of)
                done = []
        if piece:
            done.append((conv, first, bytes(piece), True))
        if done:
            yield table(done, of)

    def table(done: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((of, pa.int64(), pa.binary(), pa.bool_()))], names=["conv_id", "first", "codes", "edge"])

    spread = codes.repartition(partitions(turns.sparkSession), "chunk").sortWithinPartitions("chunk", "at")
    return materialize(spread.mapInArrow(cut, f"conv_id {kind}, first long, codes binary, edge boolean"), "pieces")


def _moves(pieces: DataFrame) -> DataFrame:
    """conv_id, first, codes, moves of all pieces."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moves = [trace(plan(x, END)[1], NONE)[0] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(moves, pa.binary())], names=["conv_id", "first", "codes", "moves"])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([matrix(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["conv_id", "first", "costs"])

    def backwards(rows: pa.Table) -> pa.Table:
        rows, after, out = rows.sort_by([("first", "descending")]), END, []
        for costs in rows["costs"].to_pylist():
            out.append(after)
            after = tuple(min(min(costs[4 * i + j] + after[j] for j in range(4)), FAR) for i in range(4))
        return pa.table({"first": rows["first"], "after": pa.array(out, pa.list_(pa.int64()))})

    def all_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = [[trace(moves, known) for known in range(4)] for codes, after in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) for moves in (plan(codes, tuple(after))[1],)]
            out = [pa.array([[m for m, _ in w] for w in ways], pa.list_(pa.binary())), pa.array([[k for _, k in w] for w in ways], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *out], names=["conv_id", "first", "codes", "ways", "known"])

    def forwards(rows: pa.Table) -> pa.Table:
        rows, known, out = rows.sort_by([("first", "ascending")]), NONE, []
        for after in rows["known"].to_pylist():
            out.append(known)
            known = after[known]
        return pa.table({"first": rows["first"], "before": pa.array(out, pa.int32())})

    inner = pieces.where("not edge").mapInArrow(whole, f"conv_id {kind}, first long, codes binary, moves binary")
    edges = pieces.where("edge").select("conv_id", "first", "codes")
    costs = edges.mapInArrow(price, f"conv_id {kind}, first long, costs array<long>")
    afters = costs.groupBy("conv_id").applyInArrow(backwards, "first long, after array<long>")
    ways = edges.join(afters, "first").select("conv_id", "first", "codes", "after").mapInArrow(all_ways, f"conv_id {kind}, first long, codes binary, ways array<binary>, known array<int>")
    ways = materialize(ways, "ways")
    befores = ways.select(F.col("conv_id").alias("of"), "first", "known").groupBy("of").applyInArrow(forwards, "first long, before int")
    joined = ways.join(befores, "first").select("conv_id", "first", "codes", F.element_at("ways", F.col("before") + 1).alias("moves"))
    return inner.unionByName(joined)


class _Conversation:
    """One conversation as its turns come by."""

    def __init__(self, conv):
        self.conv, self.known, self.role, self.turn, self.first, self.sizes = conv, NONE, None, None, None, [0] * 7
        self.audit, self.hash, self.begun = [], hashlib.sha256(), False

    def put(self, edit: str, role: str, text: str) -> tuple:
        self.audit.append(edit)
        self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
        self.begun = True
        return (self.conv, edit, role, text)

    def insert(self, role: int) -> tuple:
        self.known = role
        self.sizes[6] += INSERT
        return self.put("I", ROLES[role - 1], "")

    def take(self, turn, role: str, text: str, code: int, move: int) -> Iterator[tuple]:
        """The repaired turns that a turn gives; sizes: distinct turns, blank, duplicate, truncated, illegal, turns, cost."""
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.sizes[0] += 1
        if code >> 2:
            self.sizes[code >> 2] += 1
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.sizes[4] += 1
        self.role = role
        self.sizes[5] += 1
        if not move:
            self.sizes[6] += DELETE
            self.audit.append("D")
            return
        if move & 8:
            yield self.insert(U if move & 3 == A else A)
        self.known = move & 3
        self.sizes[6] += (REROLE if move & 4 else 0) + (code >> 2 == TRUNCATED)
        yield self.put("R", ROLES[self.known - 1], text) if move & 4 else self.put("K", role, text)

    def end(self) -> Iterator[tuple]:
        if self.known == S:
            yield self.insert(U)
        if self.known == U:
            yield self.insert(A)

    def row(self) -> tuple:
        distinct, blank, duplicate, truncated, illegal, _, cost = self.sizes
        gaps = self.turn - self.first + 1 - distinct if distinct else 0
        return (self.conv, gaps, blank, duplicate, truncated, illegal, cost, "".join(self.audit), self.hash.hexdigest())


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(rows: DataFrame, conversations: DataFrame | None, whole: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    turns = _turns(rows)
    moves = _moves(_pieces(turns))
    kind = turns.schema["conv_id"].dataType.simpleString()
    none = lambda *cols: {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("code", "int"), ("codes", "binary"), ("moves", "binary")) if c in cols}
    cols = ["conv_id", "at", "step", "turn", "role", "text", "codes", "moves"]
    parts = turns.withColumn("step", F.lit(2)).withColumns(none("codes", "moves")).select(cols)
    parts = parts.unionByName(moves.select("conv_id", F.col("first").alias("at"), F.lit(1).alias("step"), "codes", "moves").withColumns(none("turn", "role", "text")).select(cols))
    if conversations is not None:
        named = conversations.select(F.col("conv_id").cast(kind)).distinct()
        parts = parts.unionByName(named.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("step")).withColumns(none(*cols[3:])).select(cols))
    names = ["conv_id", *(x.split()[0] for x in SUMMARY.split(", "))] if whole else ["conv_id", "place", "edit", "role", "text"]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, codes, moves, first, of = None, 0, b"", b"", 0, None
        for batch in batches:
            of, out = batch.column(0).type, []
            for conv, at, step, turn, role, text, c, m in zip(*(x.to_pylist() for x in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out += finish(now, place)
                    now, place = _Conversation(conv), 0
                if step == 1:
                    codes, moves, first = c, m, at
                elif step == 2:
                    for x in now.take(turn, role, text, codes[at - first], moves[at - first]):
                        if not whole:
                            out.append((x[0], place, *x[1:]))
                        place += 1
            if out:
                yield table(out, of)
        if now is not None and (out := finish(now, place)):
            yield table(out, of)

    def finish(now: _Conversation, place: int) -> list[tuple]:
        last = [(x[0], place + i, *x[1:]) for i, x in enumerate(now.end())]
        return [now.row()] if whole else last

    def table(out: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        kinds = [of, *([pa.int64()] * 6 + [pa.string()] * 2 if whole else [pa.int64(), pa.string(), pa.string(), pa.string()])]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

    spread = parts.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at", "step")
    return spread.mapInArrow(repair, f"conv_id {kind}, " + (SUMMARY if whole else "place long, edit string, role string, text string"))


def repair_summaries(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, faults, cost, audit and the hash of the repaired turns of each conversation; conversations names those reported without turns too."""
    return _stream(rows, conversations, True)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the turns of each conversation once repaired, from place 0, inserted ones included."""
    return _stream(rows, None, False)
