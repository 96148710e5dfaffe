"""Operator 13, repair of conversation structure: a time-major tensor of costs over many conversations at once.

A repaired conversation's role initials are `(s?(ua)+)?`. States of that pattern: 0 nothing yet, 1 after the system turn, 2 after a
user turn, 3 after an assistant turn; 0 and 3 may end. Each turn is kept (0), given the role user or assistant (1) or deleted (2,
required for blank and repeated turns); an empty turn may be inserted anywhere (5); a truncated turn that stays costs 5 more. Two
inserts next to each other never pay (they return to a state as good), so the recursion has one before each turn and one at the end.
Equal costs are settled by the least letters of the edits (D, I, K, R), each letter leading to one state.

Conversations of similar length are padded to one tensor (turns, conversations, states): costs to go are stored backwards, then all
edits are traced forwards together. Rows are dealt by ranges of (conversation, turn), so a conversation of any length is shared by many
tasks: tasks solve what lies whole within them; what crosses their borders, or exceeds PIECE rows or PIECE_BYTES, goes by pieces, whose
4 x 4 cost matrices are chained (a few numbers a piece), so that each piece knows its first state and the costs after it.

Nulls: a null role or text is one space, a null turn comes first and counts for no gap, rows without a conv_id are one conversation.
Rows of one turn are taken in order of the SHA-256 of `role:text` (a table has no order). An empty or other role can't be kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

FAR = 1 << 50
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DROP, KEEP, REROLE = 1, 2, 3
_LETTER = np.frombuffer(b"\0DKR", np.uint8)
#: State after keeping a turn, by its initial (s, u, a, other) and the state before; 4 is nowhere. State after a turn of a free role.
_KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
_FREE = np.array([2, 2, 3, 2])
#: Costs at the end: a user turn needs an assistant turn.
_END = np.array([0, FAR, 5, 0])
#: Rows and bytes of text of a piece; cells of a tensor.
PIECE, PIECE_BYTES, CELLS = 4096, 16 << 20, 1 << 19

_RAW = pa.struct(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32()), ("initial", pa.int32()), ("blank", pa.bool_()), ("truncated", pa.bool_()), ("digest", pa.string())]
)
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost", "low", "high", "distinct"]
_OUT = pa.struct([("conv_id", pa.int64()), ("turns", _TURNS), ("edits", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
_CUT = pa.schema([("part", pa.int64()), ("piece", pa.int64()), ("place", pa.int64()), ("raw", _RAW), ("out", _OUT)])
RAW = "conv_id long, turn long, role string, text string, copies int, initial int, blank boolean, truncated boolean, digest string"
OUT = "conv_id long, turns array<struct<role:string,text:string>>, edits string, " + ", ".join(f"{c} long" for c in _COUNTS)
CUT = f"part long, piece long, place long, raw struct<{RAW}>, out struct<{OUT}>"
PACKED = "conv_id long, part long, piece long, turn array<long>, role array<string>, text array<string>, initial array<int>, fault array<int>"


def choices(initial: np.ndarray, fault: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Costs to go by state of deleting, keeping and giving a role to a turn, and the least; after: costs to go behind the turn."""
    late = 5 * (fault == TRUNCATED)[:, None]
    barred = (fault == BLANK) | (fault == DUPLICATE)
    nowhere = np.concatenate([after, np.full((len(after), 1), FAR)], 1)
    drop = after + 2
    keep = np.take_along_axis(nowhere, _KEPT[initial], 1) + late
    rerole = after[:, _FREE] + 1 + late
    keep[barred] = rerole[barred] = FAR
    return drop, keep, rerole, np.minimum(drop, np.minimum(keep, rerole))


def costs_to_go(initial: np.ndarray, fault: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turns + 1, conversations, states), time-major; end: costs after the last turn."""
    out = np.empty((len(initial) + 1, *end.shape), np.int64)
    out[-1] = end
    for t in range(len(initial) - 1, -1, -1):
        least = choices(initial[t], fault[t], out[t + 1])[3]
        out[t] = np.where((t < length)[:, None], np.minimum(least, 5 + least[:, _FREE]), out[t + 1])
    return out


def traced(initial: np.ndarray, fault: np.ndarray, length: np.ndarray, start: np.ndarray, go: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edits of all conversations, the least letters among the cheapest: state inserted before each turn (0: none), edit, state after it; last state."""
    inserted, edit, into = (np.zeros(initial.shape, np.int8) for _ in range(3))
    state, every = start.copy(), np.arange(len(start))
    pick = lambda x: x[every, state]
    for t in range(len(initial)):
        live = t < length
        drop, keep, rerole, least = choices(initial[t], fault[t], go[t + 1])
        best = pick(go[t])
        dropped = pick(drop) == best
        insert = live & ~dropped & (5 + least[every, _FREE[state]] == best)
        state = np.where(insert, _FREE[state], state)
        inserted[t] = np.where(insert, state, 0)
        best = np.where(insert, pick(least), best)
        dropped, kept = pick(drop) == best, pick(keep) == best
        edit[t] = np.where(live, np.where(dropped, DROP, np.where(kept, KEEP, REROLE)), 0)
        moved = np.where(dropped, state, np.where(kept, _KEPT[initial[t], state] % 4, _FREE[state]))
        state = np.where(live, moved, state)
        into[t] = state
    return inserted, edit, into, state


def buckets(length: np.ndarray):
    """Numbers of conversations of one power of two of turns, few enough for one tensor."""
    size = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for s in np.unique(size):
        own, n = np.flatnonzero(size == s), max(1, CELLS >> int(s))
        for a in range(0, len(own), n):
            yield own[a : a + n]


def padded(flat: np.ndarray, offset: np.ndarray, own: np.ndarray) -> np.ndarray:
    length = offset[own + 1] - offset[own]
    at = offset[own][None, :] + np.arange(length.max(initial=0))[:, None]
    return flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else np.zeros(at.shape, flat.dtype)


def solved(initial: np.ndarray, fault: np.ndarray, offset: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Edits of flat turns: inserted, edit, into by turn; costs to go and last states by conversation."""
    n = len(offset) - 1
    inserted, edit, into = (np.zeros(len(initial), np.int8) for _ in range(3))
    cost, last = np.zeros(n, np.int64), start.copy()
    for own in buckets(np.diff(offset)):
        length = np.diff(offset)[own]
        i, f = padded(initial, offset, own), padded(fault, offset, own)
        go = costs_to_go(i, f, length, end[own])
        cost[own] = go[0][np.arange(len(own)), start[own]]
        *by_turn, last[own] = traced(i, f, length, start[own], go)
        live = np.arange(len(i))[:, None] < length
        at = (offset[own][None, :] + np.arange(len(i))[:, None])[live]
        for flat, value in zip((inserted, edit, into), by_turn, strict=True):
            flat[at] = value[live]
    return inserted, edit, into, cost, last


def matrices(initial: np.ndarray, fault: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """(pieces, first state, last state): least costs of a piece's turns."""
    out = np.empty((len(offset) - 1, 4, 4), np.int64)
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    for own in buckets(np.diff(offset)):
        i, f = padded(initial, offset, own), padded(fault, offset, own)
        for last in range(4):
            out[own, :, last] = costs_to_go(i, f, np.diff(offset)[own], np.tile(unit[last], (len(own), 1)))[0]
    return np.minimum(out, FAR)


def strings(letters: np.ndarray, bounds: np.ndarray) -> pa.Array:
    kept = letters != 0
    offset = np.concatenate([[0], np.cumsum(kept)])[bounds].astype(np.int32)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offset.tobytes()), pa.py_buffer(letters[kept].tobytes()))


def results(conv: pa.Array, turn: pa.Array, role: pa.Array, text: pa.Array, initial: np.ndarray, fault: np.ndarray, offset: np.ndarray, start: np.ndarray, end: np.ndarray, closes: np.ndarray) -> pa.StructArray:
    """Rows of the output for conversations (or pieces) of flat turns. closes: whether the conversation ends here."""
    n, rows = len(offset) - 1, len(initial)
    inserted, edit, into, cost, last = solved(initial, fault, offset, start, end)
    more = closes & (last == 2)
    cost = cost - np.where(closes, 0, end[np.arange(n), last])
    own = np.repeat(np.arange(n), np.diff(offset))
    before, at, tail = 2 * np.arange(rows) + own, 2 * np.arange(rows) + own + 1, 2 * offset[1:] + np.arange(n)
    letters = np.zeros(2 * rows + n, np.uint8)
    letters[before[inserted > 0]] = ord("I")
    letters[at] = _LETTER[edit]
    letters[tail[more]] = ord("I")
    bounds = np.concatenate([[0], tail + 1])
    # roles and texts of the repaired turns: places in the input's, or in the two roles and the empty text put behind them
    who, what, there = np.zeros(len(letters), np.int64), np.full(len(letters), rows), np.zeros(len(letters), bool)
    there[before], who[before] = inserted > 0, rows + (inserted == 3)
    there[at], what[at] = edit >= KEEP, np.arange(rows)
    who[at] = np.where(edit == KEEP, np.arange(rows), rows + (into == 3))
    there[tail], who[tail] = more, rows + 1
    roles = pa.concat_arrays([role, pa.array(["user", "assistant"])]).take(pa.array(who[there]))
    texts = pa.concat_arrays([text, pa.array([""])]).take(pa.array(what[there]))
    turns = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there)])[bounds].astype(np.int32)), pa.StructArray.from_arrays([roles, texts], names=["role", "text"]))
    counted = lambda mask: np.bincount(own[mask], minlength=n)
    inner = np.flatnonzero(own[1:] == own[:-1]) if rows else np.zeros(0, int)
    pair = initial[inner] * 4 + initial[inner + 1]
    known = ~np.asarray(turn.is_null()) if rows else np.zeros(0, bool)
    number = np.asarray(turn.fill_null(0), np.int64)
    seen = np.flatnonzero(known)
    new = np.ones(len(seen), bool)
    new[1:] = (own[seen[1:]] != own[seen[:-1]]) | (number[seen[1:]] != number[seen[:-1]])
    some = counted(known) > 0  # turns ascend within a conversation
    first, end_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[own[seen][::-1]], end_at[own[seen]] = number[seen][::-1], number[seen]
    columns = {
        "blank": counted(fault == BLANK), "duplicate": counted(fault == DUPLICATE), "truncated": counted(fault == TRUNCATED),
        "illegal": np.bincount(own[inner[~np.isin(pair, (1, 6, 9))]], minlength=n), "cost": cost,
        "low": pa.array(first, mask=~some), "high": pa.array(end_at, mask=~some), "distinct": np.bincount(own[seen[new]], minlength=n),
    }
    return pa.StructArray.from_arrays([conv, turns, strings(letters, bounds), *(pa.array(columns[c], pa.int64()) for c in _COUNTS)], fields=list(_OUT))


def faults(blank: np.ndarray, duplicate: np.ndarray, truncated: np.ndarray) -> np.ndarray:
    return np.where(blank, BLANK, np.where(duplicate, DUPLICATE, np.where(truncated, TRUNCATED, 0)))


def flags(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(bool)


def whole(rows: pa.RecordBatch, offset: np.ndarray) -> pa.StructArray:
    """Results of conversations that lie whole in the rows."""
    own = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    copies = np.asarray(rows.column("copies"), np.int64)
    at = np.repeat(np.arange(rows.num_rows), copies)
    c = lambda n: rows.column(n).take(pa.array(at))
    key = own[at] * max(1, rows.num_rows) + np.asarray(rows.column("digest").dictionary_encode().indices, np.int64)[at]
    duplicate = np.ones(len(at), bool)
    duplicate[np.unique(key, return_index=True)[1]] = False
    fault = faults(flags(c("blank")), duplicate, flags(c("truncated")))
    live = np.concatenate([[0], np.cumsum(copies)])[offset]
    n = len(offset) - 1
    return results(rows.column("conv_id").take(pa.array(offset[:-1])), c("turn"), c("role"), c("text"), np.asarray(c("initial"), np.int64), fault, live, np.zeros(n, np.int64), np.tile(_END, (n, 1)), np.ones(n, bool))


def cut(batches):
    """Results of the conversations that end within the task and began there; the first's, the last's and very long ones' rows by piece."""
    part = TaskContext.get().partitionId()
    piece = place = held_bytes = 0
    open_piece = True  # the first conversation may have begun in an earlier task
    held: list[pa.RecordBatch] = []
    last = None

    def raw(rows: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal place
        n = rows.num_rows
        place += n
        as_struct = pa.StructArray.from_arrays([rows.column(f.name).cast(f.type) for f in _RAW], fields=list(_RAW))
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([piece] * n, pa.int64()), pa.array(np.arange(place - n, place)), as_struct, pa.nulls(n, _OUT)], schema=_CUT)

    def parts(rows: pa.RecordBatch):
        """Rows of one conversation in pieces."""
        nonlocal piece
        size = np.asarray(pa.compute.binary_length(rows.column("text")), np.int64)
        number = np.maximum(np.arange(rows.num_rows) // PIECE, (np.cumsum(size) - size) // PIECE_BYTES)
        edge = np.flatnonzero(np.diff(number, prepend=-1))
        for a, b in zip(edge, [*edge[1:], rows.num_rows], strict=True):
            yield raw(rows.slice(a, b - a))
            piece += 1

    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        return rows[0] if len(rows) == 1 else pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        number, null = np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null())
        change = np.flatnonzero((number[1:] != number[:-1]) | (null[1:] != null[:-1])) + 1
        if last is not None and last == (number[0], null[0]):
            head = change[0] if len(change) else batch.num_rows
        else:
            head = 0
        if head:
            held.append(batch.slice(0, head))
            held_bytes += batch.slice(0, head).nbytes
        if head < batch.num_rows or held_bytes >= PIECE_BYTES:  # the held conversation ended, or is too long to hold
            if held:
                rows = one(held)
                if open_piece or head == batch.num_rows:
                    yield from parts(rows)
                    open_piece = True
                else:
                    yield from results_of(rows, np.array([0, rows.num_rows]), part, parts)
            held, held_bytes = [], 0
            if head < batch.num_rows:
                if last is not None:
                    open_piece = False
                cuts = np.concatenate([[head], change[change > head], [batch.num_rows]])
                middle = cuts[:-1]
                if open_piece and len(middle) > 1:  # the task's first conversation
                    yield from parts(batch.slice(middle[0], middle[1] - middle[0]))
                    middle, open_piece = middle[1:], False
                if len(middle) > 1:
                    rows = batch.slice(middle[0], middle[-1] - middle[0])
                    yield from results_of(rows, middle - middle[0], part, parts)
                held = [batch.slice(middle[-1])]
                held_bytes = held[0].nbytes
        last = (number[-1], null[-1])
    if held:
        yield from parts(one(held))


def results_of(rows: pa.RecordBatch, offset: np.ndarray, part: int, parts):
    """Results of whole conversations; one of more rows than a piece may have goes by pieces."""
    long = np.flatnonzero(np.diff(offset) > PIECE)
    for a, b in zip([-1, *long], [*long, len(offset) - 1], strict=True):
        if b - a > 1:
            at = offset[a + 1 : b + 1]
            some = rows.slice(at[0], at[-1] - at[0])
            out = whole(some, at - at[0])
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([-1] * n, pa.int64()), pa.array([0] * n, pa.int64()), pa.nulls(n, _RAW), out], schema=_CUT)
        if b < len(offset) - 1:
            yield from parts(rows.slice(offset[b], offset[b + 1] - offset[b]))


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    offset = np.asarray(column.offsets, np.int64)
    return column.flatten(), offset - offset[0]


def by_pieces(rows: DataFrame) -> DataFrame:
    """Results of conversations that are dealt in pieces: part, piece and the output's columns, a row for each piece."""
    rows = materialize(rows.select("part", "piece", "place", "raw.*"), "repair-rows")
    place = F.struct("part", "place")
    first = rows.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    marked = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left").withColumn("again", F.coalesce(place != F.col("first"), F.lit(False))).drop("c", "d", "first")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        copies = np.asarray(t["copies"], np.int64)
        at = np.repeat(np.arange(t.num_rows), copies)
        c = lambda n: t[n].take(pa.array(at)).combine_chunks()
        again = flags(c("again")) | (np.diff(at, prepend=-1) == 0)
        fault = faults(flags(c("blank")), again, flags(c("truncated")))
        lists = [pa.array([v.to_pylist()], pa.list_(v.type)) for v in (c("turn"), c("role"), c("text"), c("initial"), pa.array(fault, pa.int32()))]
        return pa.Table.from_arrays([*(t[n].slice(0, 1) for n in ("conv_id", "part", "piece")), *lists], names=["conv_id", "part", "piece", "turn", "role", "text", "initial", "fault"])

    packed = materialize(marked.groupBy("conv_id", "part", "piece").applyInArrow(pack, PACKED), "repair-pieces")

    def summed(batches):
        for b in batches:
            initial, offset = flat(b.column("initial"))
            turn, _ = flat(b.column("turn"))
            initial = np.asarray(initial, np.int64)
            cost = matrices(initial, np.asarray(flat(b.column("fault"))[0], np.int64), offset)
            known = [[x for x in turn[a:z].to_pylist() if x is not None] for a, z in zip(offset[:-1], offset[1:], strict=True)]
            ends = [(int(initial[a]), int(initial[z - 1])) if z > a else (None, None) for a, z in zip(offset[:-1], offset[1:], strict=True)]
            more = [[e[0] for e in ends], [e[1] for e in ends], [k[0] if k else None for k in known], [k[-1] if k else None for k in known]]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("conv_id", "part", "piece")), pa.array(cost.reshape(-1, 16).tolist(), pa.list_(pa.int64())), *(pa.array(m, pa.int64()) for m in more)], names=["conv_id", "part", "piece", "cost", "i", "j", "low", "high"])

    def chained(t: pa.Table) -> pa.Table:
        """Costs after each piece, backwards; initials and turns that meet at a border."""
        t = t.sort_by([("part", "ascending"), ("piece", "ascending")])
        cost = np.array(t["cost"].to_pylist(), np.int64).reshape(-1, 4, 4)
        n = len(cost)
        after = np.empty((n, 4), np.int64)
        after[-1] = _END
        for b in range(n - 2, -1, -1):
            after[b] = (cost[b + 1] + after[b + 1][None, :]).min(1)
        illegal, shared, initial, turn = [0] * n, [0] * n, None, None
        for b, (i, j, low, high) in enumerate(zip(*(t[c].to_pylist() for c in ("i", "j", "low", "high")), strict=True)):
            if i is not None:
                illegal[b] = int(initial is not None and initial * 4 + i not in (1, 6, 9))
                initial = j
            if low is not None:
                shared[b] = int(low == turn)
                turn = high
        lists = [pa.array(np.minimum(after, FAR).tolist(), pa.list_(pa.int64())), pa.array(illegal, pa.int64()), pa.array(shared, pa.int64()), pa.array([b == n - 1 for b in range(n)])]
        return pa.Table.from_arrays([*(t[c] for c in ("conv_id", "part", "piece")), *lists], names=["conv_id", "part", "piece", "after", "more_illegal", "shared", "closes"])

    def stops(batches):
        """Last state of each piece for each first state."""
        for b in batches:
            initial, offset = flat(b.column("initial"))
            end = np.array(b.column("after").to_pylist(), np.int64).reshape(-1, 4)
            args = np.asarray(initial, np.int64), np.asarray(flat(b.column("fault"))[0], np.int64), offset
            last = [solved(*args, np.full(len(end), s), end)[4] for s in range(4)]
            kept = [b.column(n) for n in ("conv_id", "part", "piece", "after", "more_illegal", "shared", "closes")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.stack(last, 1).tolist(), pa.list_(pa.int64()))], names=["conv_id", "part", "piece", "after", "more_illegal", "shared", "closes", "stop"])

    def started(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("piece", "ascending")])
        start, state = [], 0
        for stop in t["stop"].to_pylist():
            start.append(state)
            state = stop[state]
        return t.drop_columns(["stop"]).append_column("start", pa.array(start, pa.int64()))

    def finished(batches):
        for b in batches:
            (turn, offset), (role, _), (text, _), (initial, _), (fault, _) = (flat(b.column(n)) for n in ("turn", "role", "text", "initial", "fault"))
            end = np.array(b.column("after").to_pylist(), np.int64).reshape(-1, 4)
            out = results(b.column("conv_id"), turn, role, text, np.asarray(initial, np.int64), np.asarray(fault, np.int64), offset, np.asarray(b.column("start"), np.int64), end, flags(b.column("closes")))
            columns = dict(zip([f.name for f in _OUT], out.flatten(), strict=True))
            columns["illegal"] = pa.compute.add(columns["illegal"], b.column("more_illegal"))
            columns["distinct"] = pa.compute.subtract(columns["distinct"], b.column("shared"))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("piece"), *columns.values()], names=["part", "piece", *columns])

    head = "conv_id long, part long, piece long"
    tail = f"{head}, after array<long>, more_illegal long, shared long, closes boolean"
    same = lambda df: df.select(*(F.col(c).alias("k_" + c) for c in ("conv_id", "part", "piece")), *(c for c in df.columns if c not in ("conv_id", "part", "piece")))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        on = [F.col("conv_id").eqNullSafe(F.col("k_conv_id")), F.col("part") == F.col("k_part"), F.col("piece") == F.col("k_piece")]
        return left.join(same(right), on, "inner").drop("k_conv_id", "k_part", "k_piece")

    costs = packed.select("conv_id", "part", "piece", "turn", "initial", "fault").mapInArrow(summed, f"{head}, cost array<long>, i long, j long, low long, high long")
    after = materialize(costs.groupBy("conv_id").applyInArrow(chained, tail), "repair-costs")
    stop = beside(packed.select("conv_id", "part", "piece", "initial", "fault"), after).mapInArrow(stops, f"{tail}, stop array<long>")
    start = materialize(stop.groupBy("conv_id").applyInArrow(started, f"{tail}, start long"), "repair-starts")
    return beside(packed, start).mapInArrow(finished, f"part long, piece long, {OUT}")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations, a row for each piece (nearly always one a conversation): turns, letters of the edits, counts and cost.

    rows: conv_id, turn, role, text and copies (0: the turn is gone, only the conversation counts; 2: it stands twice). Pieces of a
    conversation are ordered by (part, piece); whole ones have piece -1. low, high and distinct are of the turns that aren't null.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    ending = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    first = F.substring("role", 1, 1)
    rows = (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.col("copies").cast("int").alias("copies"))
        .withColumn("initial", F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3))
        .withColumn("blank", ending == "")
        .withColumn("truncated", ~F.substring(ending, -1, 1).isin(".", "!", "?"))
        .withColumn("digest", F.sha2(F.concat_ws(":", "role", "text"), 256))
        .withColumn("salt", F.monotonically_increasing_id())  # equal rows may be dealt to several tasks
    )
    dealt = rows.repartitionByRange("conv_id", "turn", "digest", "salt").sortWithinPartitions("conv_id", "turn", "digest").drop("salt")
    done = materialize(dealt.mapInArrow(cut, CUT), "repair-cut")
    return done.where("out is not null").select("part", "piece", "out.*").unionByName(by_pieces(done.where("out is null")))


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's faults: by crc32(`conv_id:turn`) % 20 a turn is dropped, emptied, loses its ends of sentences, stands twice, or gets role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    body = F.when(kind < 2, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"), body.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def digested(pieces: DataFrame) -> DataFrame:
    """One row a conversation: its faults, cost, edits and the SHA-256 of its repaired turns."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    pieces = pieces.withColumn("text", lines).withColumn("n", F.size("turns")).drop("turns")
    single = pieces.where("piece < 0").select("conv_id", gaps, *counts, F.col("edits").alias("audit"), F.sha2("text", 256).alias("repaired_sha256"))
    split = pieces.where("piece >= 0")

    def hashed(batches):
        """Turns stream through the hash in order: nothing of a conversation is held."""
        state, key = None, None
        done: list[tuple] = []
        for b in batches:
            for conv, n, text in zip(b.column("conv_id").to_pylist(), b.column("n").to_pylist(), b.column("text"), strict=True):
                if state is None or key != (conv,):
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    state, key, some = hashlib.sha256(), (conv,), False
                if n:
                    state.update((b"\n" if some else b"") + text.as_buffer().to_pybytes())
                    some = True
        if state is not None:
            done.append((*key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.string()))], names=["k", "repaired_sha256"])

    hashes = split.select("conv_id", "part", "piece", "n", "text").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(hashed, "k long, repaired_sha256 string")
    edits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "edits"))), lambda x: x["edits"]), "").alias("audit")  # the audit itself
    sums = split.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in [*counts, "distinct"]), F.min("low").alias("low"), F.max("high").alias("high"), edits)
    joined = sums.join(hashes, F.col("conv_id").eqNullSafe(F.col("k"))).select("conv_id", gaps, *counts, "audit", "repaired_sha256")
    return single.unionByName(joined)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(repair(damage(table(spark, sf_dir, "conversations"))))
