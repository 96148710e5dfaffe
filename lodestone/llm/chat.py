"""Chat formatting: transcripts without reliable roles are parsed by a hidden Markov model and rendered canonically.

States are the first and the further lines of a system, user or assistant turn. Each line shows a speaker
marker's class and a few line features; Viterbi recovers the likeliest states, and turns are rendered as
<|role|>, text, <|end|>.

The model's probabilities are learned by Baum-Welch from the lines of training conversations alone, never from
their roles: expected counts of a block of lines are taken under the present model, summed over all blocks as
integers (so the sums don't depend on how blocks are dealt), and added to PRIOR_WEIGHT counts of a prior, which
gives the states their meaning. Conversations whose crc32(conv_id as text) mod 5 is 2 are held out; those without
an id are training text. Without training text the prior is the model.

Defined results: a null or blank transcript has no turns and renders empty; a marker's text is removed from
its line; unknown markers are text; ties go to the state first in STATES; repeated rows are turns of their
own, ordered by turn, role and text. A conversation of any length is one result: its turns are dealt by their
place into blocks of PART_TURNS, each block's best ways from state to state are found by itself, combined in
order, and traced back within the blocks, so the states are those of the whole transcript.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, table

ROLES = ("system", "user", "assistant")
STATES = [(r, first) for r in ROLES for first in (True, False)]
PART_TURNS = 256

# fixed values: speaker markers of common transcript styles
MARKERS = {
    "system": ("System:", "SYSTEM:", "### System:", "[system]", "<system>"),
    "user": ("User:", "Human:", "Q:", "### Instruction:", "[user]", "<user>", "Customer:"),
    "assistant": ("Assistant:", "AI:", "A:", "### Response:", "[assistant]", "<assistant>", "Agent:"),
}
_ROLE_OF = {m.lower(): r for r, own in MARKERS.items() for m in own}
_MARKER = re.compile(r"\s*(" + "|".join(re.escape(m) for m in sorted(_ROLE_OF, key=len, reverse=True)) + r")[ \t]*", re.IGNORECASE)


#: Log-likelihoods are integers, so that sums don't depend on where a transcript is cut; and that of what can't be.
UNIT, NEVER = 1 << 28, -(1 << 55)


def _log(rows) -> np.ndarray:
    p = np.array(rows, float)
    return np.where(p > 0, np.rint(np.log(np.where(p > 0, p, 1)) * UNIT), NEVER).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Probabilities by state, in the order of STATES: of the first line, of the next line's state, of marker classes (system, user,
    assistant, none) and of yes and no for each line feature (the line before is blank, the line asks, it begins in lower case)."""

    start: np.ndarray
    step: np.ndarray
    mark: np.ndarray
    features: np.ndarray

    @cached_property
    def emission(self) -> np.ndarray:
        """Probability of each symbol (8 * marker class + the features' bits, 1 for no) in each state."""
        of = np.arange(32)
        return self.mark[:, of >> 3] * np.prod([self.features[k][:, (of >> (2 - k)) & 1] for k in range(3)], axis=0)

    @cached_property
    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihoods of start, step and symbols."""
        of, mark, features = np.arange(32), _log(self.mark), _log(self.features)
        return _log(self.start), _log(self.step), mark[:, of >> 3] + sum(features[k][:, (of >> (2 - k)) & 1] for k in range(3))


PRIOR = Model(
    start=np.array([0.2, 0, 0.7, 0, 0.1, 0]),
    step=np.array(
        [
            [0.02, 0.38, 0.55, 0, 0.05, 0],
            [0.02, 0.48, 0.45, 0, 0.05, 0],
            [0.01, 0, 0.04, 0.40, 0.55, 0],
            [0.01, 0, 0.04, 0.50, 0.45, 0],
            [0.01, 0, 0.40, 0, 0.04, 0.55],
            [0.01, 0, 0.34, 0, 0.04, 0.61],
        ]
    ),
    mark=np.array([[0.86, 0.01, 0.01, 0.12], [0.005, 0.005, 0.005, 0.985], [0.01, 0.86, 0.01, 0.12], [0.005, 0.005, 0.005, 0.985], [0.01, 0.01, 0.86, 0.12], [0.005, 0.005, 0.005, 0.985]]),
    features=np.array(
        [
            [[0.5, 0.5], [0.1, 0.9], [0.5, 0.5], [0.1, 0.9], [0.5, 0.5], [0.1, 0.9]],
            [[0.05, 0.95], [0.05, 0.95], [0.35, 0.65], [0.15, 0.85], [0.1, 0.9], [0.07, 0.93]],
            [[0.05, 0.95], [0.2, 0.8], [0.15, 0.85], [0.25, 0.75], [0.05, 0.95], [0.2, 0.8]],
        ]
    ),
)
START, STEP, _ = PRIOR.logs
#: Counts of the prior in each row of the model, and rounds of Baum-Welch.
PRIOR_WEIGHT, ROUNDS = 200.0, 6
#: A count of one, in the units that are summed; and cells (lines x blocks) of one tensor.
COUNT, CELLS = 1 << 20, 1 << 17


def symbols(lines: list[str], before: bool = True) -> tuple[np.ndarray, list[str]]:
    """What each line shows, and the lines without their markers. before: the line before is blank."""
    seen, bare = np.zeros(len(lines), np.uint8), []
    for i, line in enumerate(lines):
        m = _MARKER.match(line)
        role = _ROLE_OF[m[1].lower()] if m else None
        bare.append(line[m.end() :] if m else line)
        kind = ROLES.index(role) if role else 3
        seen[i] = 8 * kind + 4 * (not before) + 2 * (not line.rstrip().endswith("?")) + (not bare[-1][:1].islower())
        before = not line.strip()
    return seen, bare


def observe(lines: list[str], before: bool = True, model: Model = PRIOR) -> tuple[np.ndarray, list[str]]:
    """Log-likelihood of each line in each state, and the lines without their markers. before: the line before is blank."""
    seen, bare = symbols(lines, before)
    return np.ascontiguousarray(model.logs[2][:, seen].T), bare


def viterbi(emit: np.ndarray, entry: np.ndarray | None = None, leave: int | None = None, model: Model = PRIOR) -> list[int]:
    """Likeliest states; of a block, by the likelihoods of the states before it and the state that its last line is in."""
    start, step, _ = model.logs
    best = (start if entry is None else (entry[:, None] + step).max(axis=0)) + emit[0]
    back = []
    for row in emit[1:]:
        ways = best[:, None] + step
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    path = [int(best.argmax()) if leave is None else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def expected_counts(blocks: list[tuple[bytes, bool]], model: Model) -> np.ndarray:
    """Sums over blocks (symbols of their lines, whether they begin a conversation) of expected counts: start, step and state by symbol.

    All blocks of similar length go through the forward and backward recursions at once, one line of each at a time. A
    block that begins no conversation follows any state alike.
    """
    n = len(STATES)
    start, step, seen_in = np.zeros(n, np.int64), np.zeros((n, n), np.int64), np.zeros((32, n), np.int64)
    order = sorted((b for b in blocks if b[0]), key=lambda b: len(b[0]))
    units = lambda x: np.rint(x * COUNT).astype(np.int64)
    table_ = np.ascontiguousarray(model.emission.T)
    while order:
        longest = len(order[-1][0])
        many = max(1, CELLS // longest)
        own, order = order[-many:], order[:-many]
        length = np.array([len(s) for s, _ in own])
        x = np.zeros((longest, len(own)), np.uint8)
        for i, (s, _) in enumerate(own):
            x[: len(s), i] = np.frombuffer(s, np.uint8)
        first = np.array([f for _, f in own])
        ahead, scale = np.empty((longest, len(own), n)), np.empty((longest, len(own)))
        now = np.where(first[:, None], model.start, model.step.mean(axis=0)) * table_[x[0]]
        for t in range(longest):
            if t:
                now = (ahead[t - 1][:, :, None] * model.step).sum(axis=1) * table_[x[t]]
            scale[t] = now.sum(axis=1)
            ahead[t] = now / scale[t][:, None]
        behind = np.ones((len(own), n))
        for t in range(longest - 1, -1, -1):
            live, more = length > t, length > t + 1
            if more.any():
                after = np.where(more[:, None], table_[x[min(t + 1, longest - 1)]] * behind / scale[min(t + 1, longest - 1)][:, None], 0.0)
                moves = ahead[t][:, :, None] * model.step * after[:, None, :]
                step += units(moves[more]).sum(axis=0)
                behind = np.where(more[:, None], (model.step * after[:, None, :]).sum(axis=2), 1.0)
            state = units(ahead[t] * behind)
            np.add.at(seen_in, x[t][live], state[live])
            if t == 0:
                start += state[first].sum(axis=0)
    return np.concatenate([start, step.ravel(), seen_in.ravel()])


def renewed(counts: np.ndarray) -> Model:
    """The model of expected counts (in units of COUNT) and the prior's."""
    n, k = len(STATES), np.asarray(counts, float) / COUNT
    seen = k[n + n * n :].reshape(4, 2, 2, 2, n)
    rows = lambda own, prior: (own + PRIOR_WEIGHT * prior) / (own + PRIOR_WEIGHT * prior).sum(axis=-1, keepdims=True)
    features = np.stack([seen.sum(axis=tuple(a for a in range(4) if a != f + 1)).T for f in range(3)])
    return Model(rows(k[:n], PRIOR.start), rows(k[n : n + n * n].reshape(n, n), PRIOR.step), rows(seen.sum(axis=(1, 2, 3)).T, PRIOR.mark), rows(features, PRIOR.features))


def held_out(column: str = "conv_id") -> F.Column:
    """A row without conv_id is training text."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 2, F.lit(False))


def fit(blocks: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of training conversations: rounds of Baum-Welch over their blocks (conv_id, part, transcript)."""

    def see(batches):
        for batch in batches:
            seen = [symbols(t.split("\n"), p == 0)[0].tobytes() if t and t.strip() else b"" for t, p in zip(batch.column("transcript").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array([p == 0 for p in batch.column("part").to_pylist()], pa.bool_())], ["seen", "first"])

    lines = materialize(blocks.where(~held_out()).select("part", "transcript").mapInArrow(see, "seen binary, first boolean"), "lines")
    model = PRIOR
    for _ in range(rounds):

        def count(batches, model=model):
            for batch in batches:
                found = expected_counts(list(zip(batch.column("seen").to_pylist(), batch.column("first").to_pylist(), strict=True)), model)
                yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.int64()))], ["counts"])

        each = lines.mapInArrow(count, "counts array<long>").select(F.posexplode("counts").alias("at", "n"))
        total = {r.at: r.n for r in each.groupBy("at").agg(F.sum("n").alias("n")).collect()}  # as many rows as the model has numbers
        if not total:
            break
        model = renewed(np.array([total[i] for i in range(len(total))]))
    return model


def block_ways(emit: np.ndarray, model: Model = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood of the best way from each state before a block to each state of its last line, and which goes first on ties.

    Ties go by the states from the last line back, as in one traceback over all lines.
    """
    n, step = len(STATES), model.logs[1]
    best, back = step + emit[0], []
    for row in emit[1:]:
        ways = best[:, :, None] + step
        back.append(ways.argmax(axis=1))
        best = ways.max(axis=1) + row
    path = np.empty((len(emit), n, n), np.int8)
    path[-1] = np.arange(n)
    for i in range(len(back) - 1, -1, -1):
        path[i] = np.take_along_axis(back[i], path[i + 1].astype(np.int64), axis=1)
    first = np.empty((n, n), np.int64)
    for j in range(n):
        for place, i in enumerate(sorted(range(n), key=lambda i: (path[::-1, i, j].tobytes(), i))):
            first[i, j] = place
    return best, first


def parse(transcript: str | None, model: Model = PRIOR) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript."""
    if not transcript or not transcript.strip():
        return []
    lines = transcript.split("\n")
    emit, bare = observe(lines, model=model)
    turns: list[list] = []
    for state, line in zip(viterbi(emit, model=model), bare, strict=True):
        role, first = STATES[state]
        if first or not turns:
            turns.append([role, [line]])
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(own).strip()) for role, own in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


_TURNS = "array<struct<role:string,text:string>>"


def format_transcripts(frame: DataFrame, column: str = "transcript", model: Model = PRIOR) -> DataFrame:
    """Adds turns and rendered to a frame with a column of transcripts; columns of these names that the frame has are replaced."""
    frame = frame.drop(*({"turns", "rendered"} - {column}))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in frame.schema.fields)}, turns {_TURNS}, rendered string"

    def run(batches):
        for batch in batches:
            found = [parse(t, model) for t in batch.column(column).to_pylist()]
            turns = pa.array([[{"role": r, "text": t} for r, t in own] for own in found], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, turns, pa.array([render(own) for own in found], pa.string())], [*batch.schema.names, "turns", "rendered"])

    return frame.mapInArrow(run, schema)


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of conversations, one row for each block of PART_TURNS turns, dealt by place in the conversation.

    The style of the markers goes by conversation; of the assistant's turns, one in eight has none.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int")
    named = {r: F.element_at(F.array(*[F.lit(m) for m in MARKERS[r][:4]]), style + 1) for r in ROLES}
    marker = F.when(F.col("role") == "system", named["system"]).when(F.col("role") == "assistant", named["assistant"]).otherwise(named["user"])
    silent = (F.col("role") == "assistant") & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0)
    line = F.when(silent, F.col("text")).otherwise(F.concat_ws(" ", marker, F.col("text")))
    rows = rows.select("conv_id", "turn", "role", line.alias("line"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "line", "row"]
    # places within a conversation, however many of its rows have one turn number: rows of a range, and of the ranges before
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    placed = materialize(placed.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "turns")
    ranges = placed.groupBy("conv_id", "range").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")
    ranges = ranges.select(F.col("conv_id").alias("conv"), F.col("range").alias("of"), (before - F.col("low")).alias("add"))
    numbered = placed.join(ranges, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("range") == F.col("of")))
    place = F.col("at") + F.col("add")
    part = F.floor(place / PART_TURNS)
    turn = F.struct(place.alias("place"), "role", "line")
    grouped = numbered.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return grouped.select(
        "conv_id",
        "part",
        F.concat_ws("\n", F.transform("t", lambda t: t["line"])).alias("transcript"),
        F.concat_ws(",", F.transform("t", lambda t: F.coalesce(t["role"], F.lit("user")))).alias("true_roles"),
    )


def _same(conv: str) -> F.Column:
    return F.col("conv_id").eqNullSafe(F.col(conv))


def carried(blocks: DataFrame, model: Model = PRIOR) -> DataFrame:
    """conv, of (block), entry (likelihoods of the states before the block), blank (the line before) and leave (its last state).

    Of conversations with several blocks; the first block's entry is null.
    """
    several = blocks.where("part = 1").select(F.col("conv_id").alias("conv"))
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def ways(batches):
        for batch in batches:
            found = []
            for text in batch.column("transcript").to_pylist():
                lines = text.split("\n")
                emits = [observe(lines, blank, model)[0] for blank in (False, True)]
                found.append((b"".join(x.tobytes() for e in emits for x in block_ways(e, model)), _ends(emits[1], model).tobytes(), not lines[-1].strip()))
            m, start, blank = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(m, pa.binary()), pa.array(start, pa.binary()), pa.array(blank, pa.bool_())], ["conv_id", "part", "ways", "start", "blank"])

    def combine(group):
        group = group.sort_by("part")
        n = len(STATES)
        start, blank = group.column("start").to_pylist(), group.column("blank").to_pylist()
        both = [np.frombuffer(w, np.int64).reshape(2, 2, n, n) for w in group.column("ways").to_pylist()]
        now, entry = np.frombuffer(start[0], np.int64), [None]
        now = now - now.max()
        for k in range(1, len(both)):
            entry.append(now)
            now = (now[:, None] + both[k][int(blank[k - 1]), 0]).max(axis=0)
            now = now - now.max()
        leave = [int(now.argmax())]
        for k in range(len(both) - 1, 0, -1):
            best, first = both[k][int(blank[k - 1])]
            total = entry[k] + best[:, leave[-1]]
            leave.append(min(np.flatnonzero(total == total.max()).tolist(), key=lambda i, f=first, j=leave[-1]: f[i, j]))
        return pa.table([group.column("conv_id"), group.column("part"), pa.array([None if e is None else e.tobytes() for e in entry], pa.binary()), pa.array([True, *blank[:-1]], pa.bool_()), pa.array(leave[::-1], pa.int32())], names=["conv", "of", "entry", "blank", "leave"])

    long = blocks.join(several, _same("conv"), "left_semi").select("conv_id", "part", "transcript")
    found = long.mapInArrow(ways, f"conv_id {kind}, part long, ways binary, start binary, blank boolean")
    return found.groupBy("conv_id").applyInArrow(combine, f"conv {kind}, of long, entry binary, blank boolean, leave int")


def _ends(emit: np.ndarray, model: Model = PRIOR) -> np.ndarray:
    """Likelihood of each state of the last line of a transcript's first block."""
    start, step, _ = model.logs
    best = start + emit[0]
    for row in emit[1:]:
        best = (best[:, None] + step).max(axis=0) + row
    return best


def decoded(blocks: DataFrame, model: Model = PRIOR) -> DataFrame:
    """conv_id, part, true_roles, solid (not blank), lines without markers and the state of each line."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    given = blocks.join(carried(blocks, model), _same("conv") & (F.col("part") == F.col("of")), "left").select("conv_id", "part", "true_roles", "transcript", "entry", "blank", "leave")

    def run(batches):
        for batch in batches:
            states, bare, solid = [], [], []
            for text, entry, blank, leave in zip(*(batch.column(c).to_pylist() for c in ("transcript", "entry", "blank", "leave")), strict=True):
                emit, own = observe(text.split("\n"), blank is not False, model)
                states.append(bytes(viterbi(emit, None if entry is None else np.frombuffer(entry, np.int64), leave, model)))
                bare.append("\n".join(own))
                solid.append(bool(text.strip()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "true_roles")), pa.array(solid, pa.bool_()), pa.array(bare, pa.string()), pa.array(states, pa.binary())], ["conv_id", "part", "true_roles", "solid", "lines", "states"])

    return given.mapInArrow(run, f"conv_id {kind}, part long, true_roles string, solid boolean, lines string, states binary")


def _one(blocks) -> tuple:
    """roles, true roles, characters and SHA-256 of the rendering of a conversation's blocks in order."""
    roles, true, open_, chars, sha, any_solid = [], [], [], 0, hashlib.sha256(), False

    def close():
        text = render([(roles[-1], "\n".join(open_).strip())])
        sha.update(text.encode())
        return len(text)

    for _, true_roles, solid, lines, states in blocks:
        true.append(true_roles)
        any_solid |= solid
        for state, line in zip(states, lines.split("\n"), strict=True):
            role, first = STATES[state]
            if first or not roles:
                chars += close() if roles else 0
                roles.append(role)
                open_ = []
            open_.append(line)
    if not any_solid:
        return [], ",".join(true), 0, hashlib.sha256().hexdigest()
    chars += close()
    return roles, ",".join(true), chars, sha.hexdigest()


def rendered(conversations: DataFrame, learn: Callable[[DataFrame], Model] = lambda blocks: PRIOR) -> DataFrame:
    """conv_id, n_turns, roles, true_roles, rendered_chars and rendered_sha256 of each conversation; its blocks pass one by one.

    learn: the model for the blocks of all conversations, e.g. fit.
    """
    blocks = materialize(transcripts(conversations), "blocks")
    kind = blocks.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("roles", pa.string()), ("true_roles", pa.string()), ("rendered_chars", pa.int64()), ("rendered_sha256", pa.string())])

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "true_roles", "solid", "lines", "states")), strict=True)

    def run(batches):
        out = []
        for conv, own in groupby(rows(batches), key=lambda r: r[0]):
            roles, true, chars, sha = _one(own)
            out.append({"conv_id": conv, "n_turns": len(roles), "roles": ",".join(roles), "true_roles": true, "rendered_chars": chars, "rendered_sha256": sha})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    own = decoded(blocks, learn(blocks)).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return own.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, roles string, true_roles string, rendered_chars long, rendered_sha256 string")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rendered(table(spark, sf_dir, "conversations"), fit)
    return found.select("conv_id", "n_turns", "roles", (F.col("roles") == F.col("true_roles")).alias("roles_match"), "rendered_chars", "rendered_sha256", held_out().alias("held_out"))
