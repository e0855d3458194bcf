"""Conversation structure repair: the cheapest edits that make a conversation well formed.

A well-formed conversation is empty, or user and assistant by turns, perhaps after one system row:
``(s?(ua)+)?`` over the initials of the roles. Rows may be kept (0), given the role user or assistant
(1), deleted (2; all that can be done with blank and repeated rows), and empty user or assistant rows
may be inserted (5); a truncated row that stays adds 5. The edits are paths through a lattice of
(rows consumed, state of that pattern). A bidirectional Dijkstra search finds the least cost: a
forward and a reverse heap meet, all crossings of equal cost are finished, and the least joined audit
(the edits' initials) wins.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length spreads over tasks.
Every task searches pieces of at most ``PIECE`` rows; only conversations that may go on in another
task, or are longer, are searched for every pair of pattern states and joined from those tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a conversation searched at once.
PIECE = 128
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the pattern: start, after s, after u, after a.
STATES = range(4)
START, GOALS = 0, (0, 3)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
BEFORE = tuple({r: [q for q in STATES if NEXT[q].get(r) == to] for r in "sua"} for to in STATES)
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}
#: First characters of a text by which rows of one turn and role are ordered before its digest decides.
HEAD = 64

Label = tuple[int, str]


def _after(rows: str, at: int, state: int, trailing: bool) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, place, state) of every edit that can follow."""
    if at < len(rows):
        yield DELETE, "D", at + 1, state
        if rows[at] != "x":
            extra = TRUNCATED if rows[at].isupper() else 0
            if rows[at].lower() in NEXT[state]:
                yield extra, "K", at + 1, NEXT[state][rows[at].lower()]
            for role in ROLES:
                if role in NEXT[state]:
                    yield RENAME + extra, "R", at + 1, NEXT[state][role]
    if at < len(rows) or trailing:
        for role in ROLES:
            if role in NEXT[state]:
                yield INSERT, "I", at, NEXT[state][role]


def _ahead(rows: str, at: int, state: int, trailing: bool) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, place, state) of every edit that can lead here."""
    if at > 0:
        yield DELETE, "D", at - 1, state
        if rows[at - 1] != "x":
            extra = TRUNCATED if rows[at - 1].isupper() else 0
            for before in BEFORE[state].get(rows[at - 1].lower(), ()):
                yield extra, "K", at - 1, before
            for role in ROLES:
                for before in BEFORE[state][role]:
                    yield RENAME + extra, "R", at - 1, before
    if at < len(rows) or trailing:
        for role in ROLES:
            for before in BEFORE[state][role]:
                yield INSERT, "I", at, before


@lru_cache(maxsize=50_000)
def search(rows: str, entry: int, exits: tuple[int, ...], trailing: bool) -> Label | None:
    """Least (cost, audit) from ``entry`` before the rows to one of ``exits`` after them; None if there is no way.

    ``rows`` has a letter for each: s, u, a or o (another role), upper case if truncated, x if it must
    be deleted. Without ``trailing`` nothing is inserted after the last row. A node's audits of equal cost
    are never one another's beginnings, so the least way through a node joins its least two halves.
    Equal costs are taken by place: only keeping is free, and it moves by one row.
    """
    labels: tuple[dict, dict] = ({(0, entry): (0, "")}, {(len(rows), q): (0, "") for q in exits})
    heaps: tuple[list, list] = ([(0, 0, "", entry)], [(0, -len(rows), "", q) for q in exits])
    settled: tuple[set, set] = (set(), set())
    best = None
    for node, (cost, _) in labels[0].items():
        if node in labels[1]:
            best = cost
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, signed, audit, state = heappop(heaps[side])
        at = abs(signed)
        if (at, state) in settled[side]:
            continue
        settled[side].add((at, state))
        for price, letter, to, reached in (_ahead if side else _after)(rows, at, state, trailing):
            label = (cost + price, letter + audit if side else audit + letter)
            known = labels[side].get((to, reached))
            if known is None or label < known:
                labels[side][to, reached] = label
                heappush(heaps[side], (label[0], -to if side else to, label[1], reached))
                other = labels[1 - side].get((to, reached))
                if other is not None and (best is None or label[0] + other[0] < best):
                    best = label[0] + other[0]
    if best is None:
        return None
    crossings = ((labels[0][n], labels[1][n]) for n in labels[0].keys() & labels[1].keys())
    return best, min(a[1] + b[1] for a, b in crossings if a[0] + b[0] == best)


def join_pieces(pieces: list[tuple[list[Label | None], list[Label | None]]]) -> Label:
    """Least (cost, audit) over pieces in order, each (16 labels entry x exit, 4 labels entry to a goal).

    Audits up to the end of a piece hold as many rows and end with one, so none is another's beginning:
    their order is a rank, and no long audits are compared.
    """
    now, back = {START: (0, 0)}, []
    for steps, _ in pieces[:-1]:
        found = {}
        for q, (cost, rank) in now.items():
            for to in STATES:
                step = steps[4 * q + to]
                if step is not None:
                    offer = (cost + step[0], rank, step[1], q)
                    found[to] = min(found.get(to, offer), offer)
        order = sorted(found, key=lambda to: found[to][1:3])
        now = {to: (found[to][0], order.index(to)) for to in found}
        back.append({to: (x[3], x[2]) for to, x in found.items()})
    last = pieces[-1][1]
    cost, _, audit, q = min((c + last[q][0], rank, last[q][1], q) for q, (c, rank) in now.items() if last[q])
    audits = [audit]
    for step in reversed(back):
        q, audit = step[q]
        audits.append(audit)
    return cost, "".join(reversed(audits))


def narrow_rows(rows: DataFrame) -> DataFrame:
    """What the search needs of (conv_id, turn, role, text, copies), one row for equal rows.

    ``repeated``: the role and text stand in an earlier turn. ``blank``, ``truncated``: see the module.
    """
    end = F.rtrim("text", F.lit(SPACE))
    keyed = rows.select(
        "conv_id",
        "turn",
        "role",
        *order_keys(),
        (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
        "copies",
    )
    names = [c for c in keyed.columns if c != "copies"]
    distinct = keyed.groupBy(*names).agg(F.sum("copies").alias("copies"))
    firsts = (
        distinct.where("copies > 0 and not blank")
        .groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("text_key").alias("_key"))
        .agg(F.min(F.struct("turn")).alias("_first"))
    )
    same = (F.col("conv_id").eqNullSafe(F.col("_conv"))) & (F.col("role") == F.col("_role"))
    joined = distinct.join(firsts, same & (F.col("text_key") == F.col("_key")), "left")
    repeated = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    return joined.select(*names, "copies", repeated.alias("repeated"))


def order_keys() -> list[Column]:
    return [F.substring("text", 1, HEAD).alias("text_head"), F.unhex(F.sha2("text", 256)).alias("text_key")]


def _in_order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "text_head", "text_key"))]


class _Piece:
    """Running counts of neighbouring rows of one conversation, and a letter for each."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.rows: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn: int | None, initial: str, must: str | None, truncated: bool) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        if must == "blank":
            self.blank += 1
        elif must:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
        letter = initial if initial in ("s", "u", "a") else "o"
        self.rows.append("x" if must else letter.upper() if truncated else letter)

    def record(self, part: int, place: int, whole: bool) -> dict:
        rows = "".join(self.rows)
        steps = [] if whole else [search(rows, q, (to,), False) for q in STATES for to in STATES]
        ends = [search(rows, q, GOALS, True) for q in ([START] if whole else STATES)]
        labels = steps + ends
        return {
            **{k: getattr(self, k) for k in _COUNTS},
            **{"conv_id": self.conv_id, "part": part, "place": place, "n_rows": len(rows), "whole": whole},
            **{"costs": [x and x[0] for x in labels], "audits": [x and x[1] for x in labels]},
        }


_COUNTS = ("first", "last", "least", "most", "turns", "blank", "duplicate", "truncated", "illegal")


def _piece_schema(conv_id: T.DataType) -> T.StructType:
    kinds = {"first": T.StringType(), "last": T.StringType()}
    fields = [T.StructField(c, kinds.get(c, T.LongType())) for c in _COUNTS]
    fields += [T.StructField("conv_id", conv_id), T.StructField("part", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("place", "n_rows")]
    fields += [T.StructField("whole", T.BooleanType()), T.StructField("costs", T.ArrayType(T.LongType()))]
    return T.StructType([*fields, T.StructField("audits", T.ArrayType(T.StringType()))])


def pieces(rows: DataFrame) -> DataFrame:
    """The pieces of all conversations, searched. Rows go to tasks by ranges of their order."""
    schema = _piece_schema(rows.schema["conv_id"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece, place, runs, out = None, 0, 0, []
        cut_here = False  # whether the running conversation has given a piece before

        def closed(whole: bool) -> None:
            nonlocal place
            out.append(piece.record(part, place, whole))
            place += 1

        def flushed() -> pa.RecordBatch:
            table = pa.Table.from_pylist(out, schema=_arrow(schema))
            out.clear()
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            names = ("conv_id", "turn", "role", "blank", "repeated", "truncated", "copies")
            for conv_id, turn, role, blank, repeated, truncated, copies in zip(
                *(batch.column(c).to_pylist() for c in names), strict=True
            ):
                if piece is None or piece.conv_id != conv_id:
                    if piece is not None:
                        # The first conversation of a task may have begun in another one.
                        closed(runs > 1 and not cut_here)
                    piece, cut_here, runs = _Piece(conv_id), False, runs + 1
                for copy in range(copies):
                    if len(piece.rows) == PIECE:
                        closed(False)
                        piece, cut_here = _Piece(conv_id), True
                    must = "blank" if blank else "repeated" if repeated or copy else None
                    piece.add(turn, role[:1], must, truncated)
                if len(out) >= 2000:
                    yield flushed()
        if piece is not None:
            closed(False)
        if out:
            yield flushed()

    narrow = rows.select("conv_id", "turn", "role", "text_head", "text_key", "blank", "repeated", "truncated", "copies")
    return narrow.repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order()).mapInArrow(cut, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _audit_schema(conv_id: T.DataType) -> T.StructType:
    longs = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    fields = [T.StructField("conv_id", conv_id), *(T.StructField(c, T.LongType()) for c in longs)]
    return T.StructType([*fields, T.StructField("audit", T.StringType())])


def _signed(value: int) -> int:
    """As a 64-bit number wraps."""
    return (value + 2**63) % 2**64 - 2**63


def _conversation(found: list[dict]) -> dict:
    """One conversation of its pieces in order."""
    full = [p for p in found if p["n_rows"]]
    total = {c: sum(p[c] for p in full) for c in ("n_rows", "blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:], strict=False))
    timed = [p for p in full if p["least"] is not None]
    turns = sum(p["turns"] for p in timed)
    turns -= sum(a["most"] == b["least"] for a, b in zip(timed, timed[1:], strict=False))
    total["gaps"] = _signed(timed[-1]["most"] - timed[0]["least"] + 1 - turns) if timed else 0
    if not full:
        total |= {"cost": 0, "audit": ""}
    elif full[0]["whole"]:
        total |= {"cost": full[0]["costs"][0], "audit": full[0]["audits"][0]}
    else:
        tables = []
        for p in full:
            labels = [None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"], strict=True)]
            tables.append((labels[:16], labels[16:]))
        cost, audit = join_pieces(tables)
        total |= {"cost": cost, "audit": audit}
    return {"conv_id": found[0]["conv_id"], **total}


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    ``rows``: conv_id, turn (long), role, text and copies, how often the row stands there; with 0 only the
    conversation is known. Roles and texts are not null. Rows are taken by turn, null first, then by
    role, the first ``HEAD`` characters of the text and its SHA-256. A null conv_id is a conversation.
    Gaps: turns between the least and the greatest that no row has. Illegal: neighbours whose initials
    are not su, ua or au. Each row counts for its first fault. An empty table gives an empty result.
    An audit is one string, so a conversation has at most 2^31 rows.
    """
    cut = pieces(narrow_rows(rows))
    schema = _audit_schema(rows.schema["conv_id"].dataType)
    arrow = _arrow(schema)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_pylist([_conversation([p]) for p in batch.to_pylist()], schema=arrow)
                yield from table.to_batches()

    def joined(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda p: (p["part"], p["place"]))
        return pa.Table.from_pylist([_conversation(found)], schema=arrow)

    from strayrow.workspace import materialize

    cut = materialize(cut, "conversation-pieces")
    together = cut.where("not whole").groupBy("conv_id").applyInArrow(joined, schema)
    return cut.where("whole").mapInArrow(alone, schema).unionByName(together)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations, row by row: the columns of ``found`` and edit, role, text.

    ``rows`` as for ``audits``, ``found`` its result. Deleted rows are left out; a conversation begins
    with a row of null edit, role and text, so empty ones have a row too. All rows of a conversation are
    neighbours in one task and in order, streamed: no task holds a whole conversation's texts.
    """
    extra = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")]
    head = found.select("conv_id", *extra, F.lit(None).cast("long").alias("copies"), F.struct("*").alias("_found"))
    body = rows.where("copies > 0").select(
        "conv_id", "turn", "role", "text", F.col("copies").cast("long"), F.lit(None).cast(head.schema["_found"].dataType).alias("_found")
    )
    both = head.unionByName(body).select("*", *order_keys())
    first = [F.col("conv_id").asc_nulls_first(), F.col("_found").isNull().asc()]
    dealt = both.repartition("conv_id").sortWithinPartitions(*first, *_in_order()[1:])
    schema = T.StructType(
        [*found.schema.fields, *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))]
    )
    arrow, names = _arrow(schema), found.columns

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, audit, at, state = None, "", 0, START

        def inserted() -> Iterator[dict]:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                role = next(r for r in ROLES if r in NEXT[state])
                at, state = at + 1, NEXT[state][role]
                yield {**known, "edit": "I", "role": ROLES[role], "text": ""}

        def edited(row: dict) -> Iterator[dict]:
            nonlocal known, audit, at, state
            if row["_found"] is not None:
                known, audit, at, state = row["_found"], row["_found"]["audit"], 0, START
                yield {**known, "edit": None, "role": None, "text": None}
                yield from inserted()
                return
            for _ in range(row["copies"]):
                letter, role = audit[at], row["role"]
                at += 1
                if letter == "R":
                    role = next(ROLES[r] for r in ROLES if r in NEXT[state])
                if letter != "D":
                    state = NEXT[state][role[:1]]
                    yield {**known, "edit": letter, "role": role, "text": row["text"]}
                yield from inserted()

        out, size = [], 0
        for batch in batches:
            for row in batch.select(["role", "text", "copies", "_found"]).to_pylist():
                for made in edited(row):
                    out.append(made)
                    size += len(made["text"] or "") + 100
                    if size > 1 << 22:
                        yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
                        out, size = [], 0
        if out:
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    return dealt.mapInArrow(edit, schema).select(*names, "edit", "role", "text")


def digests(mended: DataFrame) -> DataFrame:
    """A row a conversation of ``repaired``'s result: its counts, and the SHA-256 of its ``role:text`` lines."""
    names = mended.columns[:-3]
    schema = T.StructType([*(mended.schema[c] for c in names), T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, digest, lines = None, None, 0
        out = []
        for batch in batches:
            heads = batch.select(names)
            rows = zip(*(batch.column(c).to_pylist() for c in ("edit", "role", "text")), strict=True)
            for at, (kind, role, text) in enumerate(rows):
                if kind is None:
                    if known is not None:
                        out.append({**known, "repaired_sha256": digest.hexdigest()})
                    known, digest, lines = heads.slice(at, 1).to_pylist()[0], hashlib.sha256(), 0
                    continue
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
            if out:
                yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
                out = []
        if known is not None:
            out = [{**known, "repaired_sha256": digest.hexdigest()}]
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    return mended.mapInArrow(hashed, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn``: dropped, emptied, cut, repeated, wrongly named.

    Nulls in role and text, and in the id and turn where they are hashed, are one space.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
