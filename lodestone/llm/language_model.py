"""Language-model scoring by a hierarchical Pitman-Yor model over all training text.

Tokens are words (A-Z lower-cased) and one end. The vocabulary is dealt by hash into word groups, and
    P(word | context) = P(group | context) * P(word | context, group)
where the second factor is a hierarchy of restaurants: one for each context (the preceding word, hashed to
one of CELLS cells) within the group, all sharing the group's parent, which rests on the uniform
distribution over the group's words. Customers are seated by Gibbs sweeps (each is removed and drawn anew)
and predictive probabilities are averaged over the last sweeps. The first factor is smoothed by the group's
share of all tokens. A group holds all it needs but for the context totals, a table of CELLS numbers.
Unknown words are one class, as in the base score, with the Good-Turing share of words seen once.

Defined results: null and empty texts are one end; without training text every token is unknown with
probability one half; repeated rows are scored each; a row without doc_id is
training text; very long texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, doc_columns, materialize, slices, table

CELLS = 1 << 16
END, BEGIN = 0x5DEECE66D1234567, 0x2545F4914F6CDD1D
DISCOUNT, STRENGTH, PARENT_DISCOUNT, PARENT_STRENGTH, GROUP_STRENGTH = 0.75, 2.0, 0.6, 10.0, 4.0
BURN_IN, SAMPLES, ROUNDS = 2, 3, 32
#: Tokens in a word group, about, and groups at least.
GROUP_TOKENS, LEAST_GROUPS = 2_000_000, 64
#: Beside 1 (held out) and 0.
NO_ID = 2


def held_out(column: str = "doc_id") -> F.Column:
    """A row without doc_id is training text."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context cell and text of each token."""
    words = Words(column, lower=True)
    n = words.count()
    doc = np.repeat(np.arange(len(n)), n + 1)
    last = np.cumsum(n + 1) - 1
    tokens = np.full(len(doc), END, np.uint64)
    body = np.ones(len(doc), bool)
    body[last] = False
    tokens[body] = words.hash
    before = np.empty(len(doc), np.uint64)
    before[1:] = tokens[:-1]
    before[last - n] = BEGIN
    return tokens, (before >> np.uint64(48)).astype(np.uint16), doc


def _with_fold(docs: DataFrame) -> DataFrame:
    return doc_columns(docs).withColumn("held", held_out())


def context_totals(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Training tokens after each context cell, and all tokens (held-out ones as well)."""
    block = 4096

    def count(batches):
        total, every = np.zeros(CELLS, np.int64), 0
        for batch in slices(batches):
            _, cell, doc = token_stream(batch.column("text"))
            train = ~np.asarray(batch.column("held"))[doc]
            total += np.bincount(cell[train], minlength=CELLS)
            every += len(doc)
        for k in range(0, CELLS, block):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + block].tolist()], pa.list_(pa.int64())), pa.array([every if k == 0 else 0], pa.int64())], ["block", "counts", "every"])

    rows = _with_fold(docs).mapInArrow(count, "block int, counts array<long>, every long")
    sums = rows.select("block", "every", F.posexplode("counts").alias("i", "n")).groupBy((F.col("block") + F.col("i")).alias("cell")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("i") == 0, F.col("every"))).alias("every"))
    out, every = np.zeros(CELLS, np.int64), 0
    for r in sums.collect():  # CELLS rows, whatever the input
        out[r.cell] = r.n
        every += r.every or 0
    return out, every


class Seating:
    """Customers of many independent dishes at tables. Dish i has count[i] customers, all at one table at first."""

    def __init__(self, count: np.ndarray, rng: np.random.Generator):
        self.count, self.rng = count, rng
        self.tables = (count > 0).astype(np.int64)
        many = np.flatnonzero(count > 1)
        c = count[many]
        base = (np.cumsum(c) - c).astype(np.int64)
        self.dish = np.repeat(many, c).astype(np.int32)
        self.first = np.repeat(base, c).astype(np.int32)
        nth = np.arange(len(self.dish), dtype=np.int32) - self.first
        order = np.argsort(nth % ROUNDS, kind="stable").astype(np.int32)
        self.rounds = np.split(order, np.searchsorted(nth[order] % ROUNDS, np.arange(1, ROUNDS)))
        # each customer has two labels of its own for tables that it opens
        self.size = np.zeros(2 * len(self.dish), np.int32)
        self.at = 2 * self.first
        self.size[2 * base] = c

    def sweep(self, new_weight, discount: float) -> None:
        """Each customer leaves and is seated anew: at a table in proportion to its size less the discount, or at a new one.

        new_weight(dishes) is the weight of a new table. A sweep has ROUNDS rounds; dishes of up to ROUNDS
        customers are drawn one by one, larger ones a share of their customers at a time.
        """
        rng, size, at = self.rng, self.size, self.at
        for r, who in enumerate(self.rounds):
            if not len(who):
                continue
            dish, old = self.dish[who], at[who]
            np.subtract.at(size, old, 1)
            self._change(np.unique(old[size[old] == 0]), -1)
            own = self.count[dish]
            there = own - (own - r + ROUNDS - 1) // ROUNDS  # less those of this round
            rest = np.maximum(there - discount * self.tables[dish], 0.0)
            new = new_weight(dish)
            opens = (rng.random(len(who)) * (new + rest) < new) | (rest <= 0)
            label = np.where(size[2 * who] == 0, 2 * who, 2 * who + 1)
            opens &= size[label] == 0
            seat = np.where(opens, label, -1)
            todo = np.flatnonzero(~opens)
            # drawn until accepted: at least one in eight draws is, as the others of the dish sit at tables
            while len(todo):
                mine = who[todo]
                table_ = at[self.first[mine] + (rng.random(len(todo)) * self.count[self.dish[mine]]).astype(np.int32)]
                n = size[table_]
                good = (n > 0) & (rng.random(len(todo)) * n < n - discount)
                seat[todo[good]] = table_[good]
                todo = todo[~good]
            self._change(label[opens], 1)
            at[who] = seat
            np.add.at(size, seat, 1)

    def _change(self, labels: np.ndarray, by: int) -> None:
        np.add.at(self.tables, self.dish[labels // 2], by)


def predictive(word: np.ndarray, cell: np.ndarray, count: np.ndarray, n_words: int, seed: int) -> np.ndarray:
    """P(word | context, group) of each distinct pair (word, cell) with its training count, averaged over samples.

    word: 0 .. n_words - 1 for the group's training words.
    """
    rng = np.random.default_rng(seed)
    cells, u = np.unique(cell, return_inverse=True)
    seats = Seating(count, rng)
    c_u = np.bincount(u, count, len(cells))
    total = np.zeros(len(word))
    for s in range(BURN_IN + SAMPLES):
        t_u = np.bincount(u, seats.tables, len(cells))
        c_1 = np.bincount(word, seats.tables, n_words).astype(np.int64)
        parent = Seating(c_1, rng)
        parent.sweep(lambda w, p=parent: (PARENT_STRENGTH + PARENT_DISCOUNT * p.tables.sum()) / n_words, PARENT_DISCOUNT)
        p_1 = (c_1 - PARENT_DISCOUNT * parent.tables + (PARENT_STRENGTH + PARENT_DISCOUNT * parent.tables.sum()) / n_words) / (PARENT_STRENGTH + c_1.sum())
        if s >= BURN_IN:
            total += (count - DISCOUNT * seats.tables + (STRENGTH + DISCOUNT * t_u[u]) * p_1[word]) / (STRENGTH + c_u[u])
        if s < BURN_IN + SAMPLES - 1:
            seats.sweep(lambda i, t=t_u, p=p_1: (STRENGTH + DISCOUNT * t[u[i]]) * p[word[i]], DISCOUNT)
    return total / SAMPLES


def score_group(group: pa.Table, totals: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Sums for each document of a word group's tokens: known and all tokens, log10(c + 1), log10 P; and V and words seen once."""
    parts = {k: [] for k in ("hash", "cell", "row", "held")}
    ids, none, keys, at = [], [], [], 0
    for r in range(group.num_rows):
        words = np.frombuffer(group.column("words")[r].as_py(), np.uint64)
        many = np.frombuffer(group.column("many")[r].as_py(), np.uint32)
        rows = np.frombuffer(group.column("rows")[r].as_py(), np.uint16)
        flag = np.frombuffer(group.column("held")[r].as_py(), np.uint8)
        held = flag == 1
        none.append(flag == NO_ID)
        parts["hash"].append(np.repeat(words, many))
        parts["cell"].append(np.frombuffer(group.column("cells")[r].as_py(), np.uint16))
        parts["row"].append(rows.astype(np.int32) + at)
        parts["held"].append(held[rows])
        ids.append(np.frombuffer(group.column("doc_ids")[r].as_py(), np.int64))
        keys.append(group.column("chunk")[r].as_py() + np.frombuffer(group.column("used")[r].as_py(), np.uint16).astype(np.int64))
        at += len(held)
    hashes, cell, row, held = (np.concatenate(parts[k]) for k in ("hash", "cell", "row", "held"))
    del parts
    vocabulary, word = np.unique(hashes, return_inverse=True)
    del hashes
    word = word.astype(np.int32)
    c_w = np.bincount(word[~held], minlength=len(vocabulary))
    known_word = c_w > 0
    number = np.cumsum(known_word) - 1
    n_words = int(known_word.sum())
    known = known_word[word]
    known_row = row[known]
    out_n = np.bincount(row, minlength=at)
    out_known = np.bincount(known_row, minlength=at)
    out_base = np.bincount(known_row, np.log10(c_w + 1.0)[word[known]], at)
    out_score = np.zeros(at)
    if n_words:
        pair = (number[word[known]].astype(np.int64) << 16) | cell[known]
        distinct, inverse = np.unique(pair, return_inverse=True)
        del pair, word
        inverse = inverse.astype(np.int32)
        count = np.bincount(inverse[~held[known]], minlength=len(distinct))
        u = (distinct & 0xFFFF).astype(np.int64)
        p = predictive(distinct >> 16, u, count, n_words, seed)
        own = np.bincount(u, count, CELLS)
        share = own.sum() / max(totals.sum(), 1)
        group_p = (own[u] + GROUP_STRENGTH * share) / (totals[u] + GROUP_STRENGTH)
        out_score = np.bincount(known_row, np.log10(p * group_p)[inverse], at)
    on = out_n > 0
    return {"key": np.concatenate(keys)[on], "doc_id": np.ma.array(np.concatenate(ids)[on], mask=np.concatenate(none)[on]), "n": out_n[on], "known": out_known[on], "base": out_base[on], "score": out_score[on], "v": n_words, "once": int((c_w == 1).sum())}


def grouped_tokens(docs: DataFrame, groups: int) -> DataFrame:
    """A row for each word group and slice of documents: distinct words, how often, and context cell and text of each token."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            # 16-bit places of texts
            for k in range(0, batch.num_rows, 65536):
                own = batch.slice(k, 65536)
                tokens, cell, doc = token_stream(own.column("text"))
                order = np.argsort(tokens, kind="stable")
                tokens, cell, doc = tokens[order], cell[order], doc[order].astype(np.uint16)
                # groups are ranges of the hash, so one order serves both
                group = (((tokens >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
                held = np.asarray(own.column("held")).astype(np.uint8)
                held[np.asarray(own.column("doc_id").is_null())] = NO_ID
                ids = own.column("doc_id").fill_null(0).to_numpy()
                cut = np.flatnonzero(np.diff(group, prepend=-1))
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True):
                    words, many = np.unique(tokens[a:b], return_counts=True)
                    used, rows = np.unique(doc[a:b], return_inverse=True)
                    values = (int(group[a]), words.tobytes(), many.astype(np.uint32).tobytes(), cell[a:b].tobytes(), rows.astype(np.uint16).tobytes(), held[used].tobytes(), ids[used].tobytes(), used.tobytes(), chunk)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TOKENS.types, strict=True)], schema=_TOKENS)
                chunk += own.num_rows

    return _with_fold(docs).mapInArrow(run, "grp long, words binary, many binary, cells binary, rows binary, held binary, doc_ids binary, used binary, chunk long")


_TOKENS = pa.schema([("grp", pa.int64()), ("words", pa.binary()), ("many", pa.binary()), ("cells", pa.binary()), ("rows", pa.binary()), ("held", pa.binary()), ("doc_ids", pa.binary()), ("used", pa.binary()), ("chunk", pa.int64())])
_SUMS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("v", pa.int64()), ("once", pa.int64())])


def scores(docs: DataFrame) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text."""
    totals, every = context_totals(docs)
    spark = docs.sparkSession
    groups = max(LEAST_GROUPS, every // GROUP_TOKENS)
    sent = spark.sparkContext.broadcast(totals)  # CELLS numbers

    def run(group):
        found = score_group(group, sent.value, int(group.column("grp")[0].as_py()))
        n = len(found["key"])
        v, once = np.zeros(n, np.int64), np.zeros(n, np.int64)
        v[:1], once[:1] = found["v"], found["once"]
        found["doc_id"] = pa.array(found["doc_id"].data, mask=found["doc_id"].mask)
        return pa.table([pa.array(found[k]) if k != "doc_id" else found[k] for k in ("key", "doc_id", "n", "known", "base", "score")] + [pa.array(v), pa.array(once)], schema=_SUMS)

    tokens = grouped_tokens(docs, groups)
    sums = materialize(tokens.groupBy("grp").applyInArrow(run, "key long, doc_id long, n long, known long, base double, score double, v long, once long"), "scores")
    row = sums.agg(F.sum("v"), F.sum("once")).first()
    n_train, v, once = int(totals.sum()), row[0] or 0, row[1] or 0
    unknown = (once + 1) / (n_train + 2)
    merged = sums.groupBy("key", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n", "known", "base", "score")))
    return merged.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * math.log10(n_train + v + 1)).alias("base_score"),
        (F.col("score") + F.col("known") * math.log10(1 - unknown) + (F.col("n") - F.col("known")) * math.log10(unknown)).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """By fold: tokens, and perplexity under the model and under the base."""
    n, s, b = F.sum("n_tokens"), F.sum("score"), F.sum("base_score")
    return scored.groupBy("held_out").agg(n.alias("tokens"), F.pow(F.lit(10.0), -s / n).alias("perplexity"), F.pow(F.lit(10.0), -b / n).alias("base_perplexity"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
