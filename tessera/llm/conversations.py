"""Conversation structure repair: the cheapest edits that give the roles ``(s?(ua)+)?``, ties by the least edit letters.

Edits are arcs of a graph over (place in the conversation, state of the pattern): K keeps a row, R gives it the role
the pattern asks for, D deletes it, I inserts a turn without text.  Forward and backward minimum costs tell which arcs
lie on a cheapest path (the tight arcs); a walk over them takes the least letter that any state of its frontier offers.

Rows are ordered by range, not gathered by key.  A conversation that lies within a partition is repaired there; those at
a partition's ends, and those that outgrow a block, go on as blocks: each block's costs between states are a small
matrix, so costs at its ends come from a product over the blocks, and the walk is chained from block to block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.llm.common import stash

#: Rows and characters of a block of a conversation.
BLOCK_ROWS, BLOCK_CHARS = 20_000, 8 << 20
#: States: nothing yet, after the system turn, after a user's, after an assistant's; the first and the last accept.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_START, _ACCEPT = (0, 1 << 60, 1 << 60, 1 << 60), (_EMPTY, _ASSISTANT)
#: The turn that may follow each state, by which R and I go on.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
_KEEPS = {("s", _EMPTY): _SYSTEM, ("u", _EMPTY): _USER, ("u", _SYSTEM): _USER, ("u", _ASSISTANT): _USER, ("a", _USER): _ASSISTANT}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
_SPACE, _STOPS = " \t\n\x0b\x0c\r", ".!?"

Kind = tuple[str, bool, bool]


class _Arcs(dict):
    """The arcs of a row by (initial, truncated, must go): for each state (letter, next state, cost)."""

    def __missing__(self, kind: Kind) -> list[list[tuple[str, int, int]]]:
        initial, cut_off, must_go = kind
        self[kind] = []
        for state in range(4):
            arcs = [("D", state, DELETE)]
            if not must_go:
                extra = CUT_OFF if cut_off else 0
                if (initial, state) in _KEEPS:
                    arcs.append(("K", _KEEPS[initial, state], extra))
                arcs.append(("R", _NEXT[state], REROLE + extra))
            self[kind].append(arcs)
        return self[kind]


_ARCS = _Arcs()


def _forward(kinds: Sequence[Kind], costs: Sequence[int]) -> list[list[int]]:
    """Least costs of every state before each row and after the last, from those before the first; inserts at each place included."""
    out = []
    for kind in (None, *kinds):
        if kind is None:
            now = list(costs)
        else:
            before, now = out[-1], [1 << 60] * 4
            for cost, arcs in zip(before, _ARCS[kind]):
                for _, to, more in arcs:
                    if cost + more < now[to]:
                        now[to] = cost + more
        for _ in range(2):
            for state, to in enumerate(_NEXT):
                now[to] = min(now[to], now[state] + INSERT)
        out.append(now)
    return out


def _backward(kinds: Sequence[Kind], costs: Sequence[int]) -> list[list[int]]:
    """Least costs from every state before each row and after the last to the end, from those after the last."""
    out = [list(costs)]
    for kind in reversed(kinds):
        after = out[-1]
        now = [min(more + after[to] for _, to, more in arcs) for arcs in _ARCS[kind]]
        for _ in range(2):
            for state, to in enumerate(_NEXT):
                now[state] = min(now[state], INSERT + now[to])
        out.append(now)
    return out[::-1]


#: Costs from each state to the end where no row is left.
_END = tuple(next(n * INSERT for n, at in enumerate((s, _NEXT[s], _NEXT[_NEXT[s]])) if at in _ACCEPT) for s in range(4))


def _walk(kinds: Sequence[Kind], forward: list[list[int]], backward: list[list[int]], total: int, start: int, last: bool) -> tuple[str, list[tuple[int, int]], int]:
    """The least letters over tight arcs from a state, (row or -1, state) of each turn that they give, and the state at the end."""
    letters, turns, at, frontier = [], [], 0, {start}
    while at < len(kinds) or last and not any(s in _ACCEPT and forward[at][s] == total for s in frontier):
        tight: dict[str, set[int]] = {}
        for s in frontier:
            cost = forward[at][s]
            if at < len(kinds):
                for letter, to, more in _ARCS[kinds[at]][s]:
                    if cost + more + backward[at + 1][to] == total:
                        tight.setdefault(letter, set()).add(to)
            if cost + INSERT + backward[at][_NEXT[s]] == total:
                tight.setdefault("I", set()).add(_NEXT[s])
        letter = min(tight)
        frontier = tight[letter]
        letters.append(letter)
        if letter != "D":
            turns.append((-1 if letter == "I" else at, min(frontier) if letter != "K" else -1))
        at += letter != "I"
    return "".join(letters), turns, min(frontier)


def _kinds(roles: Sequence[str], texts: Sequence[str], copies: Sequence[int], first: Sequence[bool]) -> tuple[list[Kind], list[int], list[int]]:
    """Kind and row of every copy, and how many are blank, duplicate and truncated; ``first``: role and text not seen before."""
    kinds, rows, counts = [], [], [0, 0, 0]
    for i, (role, text, n, new) in enumerate(zip(roles, texts, copies, first)):
        held = text.strip(_SPACE)
        kind = (role[:1], bool(held) and held[-1] not in _STOPS, not held or not new)
        again = (role[:1], kind[1], True)
        kinds += [kind, *[again] * (n - 1)] if n else []
        rows += [i] * n
        if not held:
            counts[0] += n
        else:
            counts[1] += n - new
            counts[2] += new and kind[1]
    return kinds, rows, counts


def _illegal(kinds: Sequence[Kind]) -> int:
    return sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))


def _turns(turns: list[tuple[int, int]], rows: Sequence[int], roles: Sequence[str], texts: Sequence[str]) -> list[dict[str, str]]:
    return [{"role": _NAMES[s] if s >= 0 else roles[rows[i]], "text": texts[rows[i]] if i >= 0 else ""} for i, s in turns]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TURNS_TYPE = ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text with planted faults by crc32(``conv_id:turn``) % 20, and their copies (0: dropped).

    Null roles and texts are one space, as null ids and turns are in the checksum.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    return rows.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per block of a conversation: conv_id, block, whole (it's the only one), the conversation's counts and cost, and the block's audit and turns.

    ``rows`` has conv_id, turn, role, text and, optionally, copies: how often the row stands there, 0 if only its
    conversation's id counts.  Rows stand in order of turn (nulls first), role and text; equal rows are copies.  Null
    roles and texts are one space.  A null conv_id is a conversation like others; an empty role is no role that can be
    kept.  A conversation without rows has zeros, an empty audit and no turns.  An empty table gives an empty one.
    Other columns are ignored, whatever their names.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), copies.cast("long").alias("copies"))
    none = F.col("copies") == 0
    given = given.withColumns({"turn": F.when(~none, F.col("turn")), "role": F.when(none, "").otherwise(F.col("role")), "text": F.when(none, "").otherwise(F.col("text"))})
    once = given.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = ["conv_id", "turn", F.substring("role", 1, 50), F.substring("text", 1, 50)]  # a coarser order than the sort's, so that its samples are narrow
    ordered = once.repartitionByRange(*key).sortWithinPartitions("conv_id", "turn", "role", "text")
    id_field = StructField("conv_id", rows.schema["conv_id"].dataType)
    longs = lambda *names: [StructField(c, LongType()) for c in names]
    schema = StructType([id_field, *longs("block", "place", "turn"), StructField("role", StringType()), StructField("text", StringType()), *longs("copies", *_COUNTS), StructField("audit", StringType()), StructField("turns", _TURNS_TYPE)])
    kinds_of = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 7 + [pa.string(), _TURNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, done, open_ = TaskContext.get().partitionId() << 32, None, [], []
        own: list[tuple] = []
        chars, held, several, first, begun, now = 0, 0, False, False, False, object()

        def flush() -> Iterator[pa.RecordBatch]:
            """The conversation that ends here: repaired if it began and ends within this partition and its block."""
            nonlocal block, held
            if several or first:
                block += 1
                open_.extend((c, block, i, *row) for i, (c, *row) in enumerate(own))
            elif own:
                block += 1
                done.append((own[0][0], block, *_whole([r[1:] for r in own])))
            own.clear()
            held += chars
            if held >= BLOCK_CHARS or len(done) >= 500 or len(open_) >= BLOCK_ROWS:
                yield from out()
                held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for rows, width in ((open_, 7), (done, 0)):
                if rows:
                    n = len(rows)
                    columns = list(zip(*rows))
                    if width:
                        arrays = [pa.array(c, t) for c, t in zip(columns[1:], kinds_of)] + [pa.nulls(n, t) for t in kinds_of[6:]]
                    else:
                        arrays = [pa.array(columns[1], pa.int64()), *(pa.nulls(n, t) for t in kinds_of[1:6]), *(pa.array(c, t) for c, t in zip(columns[2:], kinds_of[6:]))]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *arrays], schema.names)
                    rows.clear()

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
                if row[0] != now:
                    yield from flush()
                    first, begun = not begun, True
                    now, several, chars = row[0], False, 0
                elif len(own) >= block_rows or chars >= BLOCK_CHARS:
                    several = True
                    yield from flush()
                    chars = 0
                own.append(row)
                chars += len(row[3]) + row[4]
        first = True  # the last may go on in the next partition
        yield from flush()
        yield from out()

    parts = stash(ordered.mapInArrow(run, schema), "zstd")
    whole = parts.where("turns is not null")
    open_rows = parts.where("turns is null").select("conv_id", "block", "place", "turn", "role", "text", "copies")
    return whole.select("conv_id", "block", F.lit(True).alias("whole"), *_COUNTS, "audit", "turns").unionByName(_of_blocks(open_rows, id_field))


def _whole(rows: list[tuple]) -> tuple:
    """Counts, cost, audit and turns of a conversation's rows (turn, role, text, copies)."""
    rows = [r for r in rows if r[3]]
    seen, first = set(), []
    for _, role, text, _ in rows:
        first.append((role, text) not in seen)
        seen.add((role, text))
    roles, texts = [r[1] for r in rows], [r[2] for r in rows]
    kinds, of, (blank, duplicate, truncated) = _kinds(roles, texts, [r[3] for r in rows], first)
    held = {r[0] for r in rows} - {None}
    forward, backward = _forward(kinds, _START), _backward(kinds, _END)
    total = backward[0][_EMPTY]
    audit, turns, _ = _walk(kinds, forward, backward, total, _EMPTY, True)
    gaps = max(held) - min(held) + 1 - len(held) if held else 0
    return gaps, blank, duplicate, truncated, _illegal(kinds), total, audit, _turns(turns, of, roles, texts)


def _of_blocks(rows: DataFrame, id_field: StructField) -> DataFrame:
    """The same for conversations that may be spread over blocks; every group is one block, or has a row per block."""
    longs = lambda *names: [StructField(c, LongType()) for c in names]
    vector = ArrayType(LongType())
    some = rows.where("copies > 0").withColumn("key", F.sha2("text", 256))
    seen = some.groupBy("conv_id", "role", "key").agg(F.min(F.struct("block", "place")).alias("at")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "at")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    flagged = stash(some.join(seen, same).select("conv_id", "block", "place", "turn", "role", "text", "copies", (F.struct("block", "place") == F.col("at")).alias("first")), "zstd")

    def kinds(part: pa.Table) -> tuple:
        part = part.sort_by("place")
        roles, texts, copies, first = (part.column(c).to_pylist() for c in ("role", "text", "copies", "first"))
        return *_kinds(roles, texts, copies, first), roles, texts

    facts = StructType([id_field, *longs("block", "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high"), StructField("head", StringType()), StructField("tail", StringType()), StructField("matrix", vector)])

    def summed(part: pa.Table) -> pa.Table:
        of, _, (blank, duplicate, truncated), *_ = kinds(part)
        turns = [t for t in part.column("turn").to_pylist() if t is not None]
        matrix = [c for s in range(4) for c in _forward(of, [0 if s == x else 1 << 60 for x in range(4)])[-1]]
        row = [blank, duplicate, truncated, _illegal(of), len(set(turns)), min(turns, default=None), max(turns, default=None)]
        return pa.Table.from_arrays([part.column("conv_id").slice(0, 1), part.column("block").slice(0, 1), *(pa.array([x], pa.int64()) for x in row), pa.array([of[0][0]]), pa.array([of[-1][0]]), pa.array([matrix], pa.list_(pa.int64()))], facts.names)

    sums = stash(flagged.groupBy("block").applyInArrow(summed, facts))
    ends = StructType([*longs("block"), StructField("before", vector), StructField("after", vector), *longs("total", "last")])

    def ends_of(part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        matrices = [[m[4 * s : 4 * s + 4] for s in range(4)] for m in part.column("matrix").to_pylist()]
        before, after = [list(_START)], [list(_END)]
        for m in matrices[:-1]:
            before.append([min(before[-1][s] + m[s][t] for s in range(4)) for t in range(4)])
        for m in matrices[:0:-1]:
            after.append([min(m[s][t] + after[-1][t] for t in range(4)) for s in range(4)])
        after.reverse()
        total = min(matrices[0][_EMPTY][t] + after[0][t] for t in range(4))
        n = part.num_rows
        return pa.Table.from_arrays([part.column("block"), pa.array(before, pa.list_(pa.int64())), pa.array(after, pa.list_(pa.int64())), pa.array([total] * n, pa.int64()), pa.array([0] * (n - 1) + [1], pa.int64())], ends.names)

    costs = stash(sums.groupBy("conv_id").applyInArrow(ends_of, ends))
    walked = StructType([id_field, *longs("block", "start", "stop"), StructField("audit", StringType()), StructField("turns", _TURNS_TYPE)])

    def walk(part: pa.Table, cost: pa.Table) -> pa.Table:
        of, rows_of, _, roles, texts = kinds(part)
        (cost,) = cost.to_pylist()
        forward, backward = _forward(of, cost["before"]), _backward(of, cost["after"])
        out = []
        for start in range(4):
            if cost["before"][start] + backward[0][start] == cost["total"]:
                audit, turns, stop = _walk(of, forward, backward, cost["total"], start, bool(cost["last"]))
                out.append((start, stop, audit, _turns(turns, rows_of, roles, texts)))
        columns = list(zip(*out))
        n = len(out)
        return pa.Table.from_arrays([part.column("conv_id").slice(0, 1).take(pa.array([0] * n)), part.column("block").slice(0, 1).take(pa.array([0] * n)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], _TURNS)], walked.names)

    walks = stash(flagged.groupBy("block").cogroup(costs.groupBy("block")).applyInArrow(walk, walked), "zstd")
    chosen = StructType(longs("block", "start"))

    def chain(part: pa.Table) -> pa.Table:
        stops = {(b, s): stop for b, s, stop in zip(*(part.column(c).to_pylist() for c in ("block", "start", "stop")))}
        at, out = _EMPTY, []
        for block in sorted({b for b, _ in stops}):
            out.append((block, at))
            at = stops[block, at]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], chosen.names)

    taken = walks.select("conv_id", "block", "start", "stop").groupBy("conv_id").applyInArrow(chain, chosen)
    totals = StructType([id_field, *longs(*_COUNTS)])

    def counted(part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        rows = part.to_pylist()
        within = [r for r in rows if r["distinct"]]
        shared = sum(a["high"] == b["low"] for a, b in zip(within, within[1:]))
        gaps = within[-1]["high"] - within[0]["low"] + 1 - sum(r["distinct"] for r in within) + shared if within else 0
        illegal = sum(r["illegal"] for r in rows) + sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        row = [gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal, rows[0]["total"]]
        return pa.Table.from_arrays([part.column("conv_id").slice(0, 1), *(pa.array([x], pa.int64()) for x in row)], totals.names)

    counts = sums.drop("matrix").join(costs.select("block", "total"), "block").groupBy("conv_id").applyInArrow(counted, totals).withColumnRenamed("conv_id", "c")
    blocks = walks.join(taken, ["block", "start"]).join(counts, F.col("conv_id").eqNullSafe(F.col("c")))
    gone = rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where("n = 0")
    zero = F.lit(0).cast("long")
    nothing = gone.select("conv_id", zero.alias("block"), F.lit(False).alias("whole"), *(zero.alias(c) for c in _COUNTS), F.lit("").alias("audit"), F.array().cast(_TURNS_TYPE).alias("turns"))
    return blocks.select("conv_id", "block", F.lit(False).alias("whole"), *_COUNTS, "audit", "turns").unionByName(nothing)


def summary(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, its counts and cost, the audit and the SHA-256 of its repaired ``role:text`` lines; see ``repaired``.

    The digest of a conversation that is spread over blocks reads them in order, one at a time.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    plain = repaired(rows, block_rows).withColumns({"lines": lines, "n": F.size("turns")}).drop("turns")
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *(StructField(c, LongType()) for c in _COUNTS), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, counts, ids = None, False, (), None
        audits: list[str] = []
        digest, some = hashlib.sha256(), False

        def out() -> Iterator[pa.RecordBatch]:
            if begun:
                yield pa.RecordBatch.from_arrays([pa.array([now], ids), *(pa.array([x], pa.int64()) for x in counts), pa.array(["".join(audits)]), pa.array([digest.hexdigest()])], schema.names)

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for conv, audit, text, n, *of in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "lines", "n", *_COUNTS))):
                if not begun or conv != now:
                    yield from out()
                    now, begun, counts, audits, digest, some = conv, True, of, [], hashlib.sha256(), False
                audits.append(audit)
                if n:
                    digest.update((("\n" if some else "") + text).encode())
                    some = True
        yield from out()

    spread = plain.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)
    return plain.where("whole").select("conv_id", *_COUNTS, "audit", F.sha2("lines", 256).alias("repaired_sha256")).unionByName(spread)
