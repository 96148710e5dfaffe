"""Near-duplicates by SetSketch registers: banded, estimated by joint likelihood, confirmed on full sets.

Each document's set of word shingles fills REGISTERS registers with exponentially spaced, truncated minima
(mergeable: the register-wise maximum is the union's sketch). Equal sets collapse to one representative.
Bands of equal registers propose links; the joint likelihood of two sketches estimates their similarity;
links are confirmed on the whole shingle sets and joined into components.

A band's bucket never emits all its pairs. It is first compared with one leader, then with the members
of most links. Buckets that then hold several components are compared exactly, but through pivots: with a
leader of another component as pivot, a partner must have the document's other shingles where the pivot's are
too few, and these are rare; of the others, two partners share one of the rarest quarter of either's shingles.
So near-copies of one text are told apart without comparing them in pairs.
At similarity 3/4 two sketches share no band with probability under 1e-6.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; a text of
fewer than SHINGLE words is one shingle; repeated rows with one doc_id are equal sets and share a component. Rows
without doc_id get a key made from their text (2**62 and above), so equal ones are as repeated rows with one
doc_id; they never stand for equal texts that have an id, are kept only where no smaller id is linked, and
keep_one leaves one of those with one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, as_long, doc_columns, gram_hashes, materialize, mix, powers, slices, table

SHINGLE = 5
REGISTERS, BANDS, ROWS, BASE = 256, 51, 5, 1.05
#: Similarity as a fraction, and the estimate below which a candidate is given up (over five standard errors).
NUM, DEN, ESTIMATE = 3, 4, 0.60
#: Leaders of a bucket, each of another component.
LEADERS = 3
#: Leaders that a document is compared with at first.
MEETINGS = 4
#: A shingle in so many documents of other components (and twice as many in all) counts as common.
COMMON = 100
#: Documents of a shingle in one list, about.
BLOCK_ROWS = 256


def shingle_sets(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document."""
    grams = gram_hashes(words.hash, k)
    out = []
    for a, b in zip(words.doc_off[:-1].tolist(), words.doc_off[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            # a short text is one shingle; its length keeps it apart from full shingles
            own = words.hash[a:b]
            out.append(mix(np.array([(own * powers(0xA0761D6478BD642F, b - a)[0]).sum() ^ np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, modulo 256; an empty set's are zeros.

    An element's arrivals at the registers are one Poisson process: its gaps and the registers hit come
    from a chain of hashes, so equal elements hit alike in every document. Only arrivals early enough to
    matter for a set of that size are drawn; where a register stays empty, the set is drawn for longer.
    """
    n = np.array([len(s) for s in sets], np.int64)
    first = np.full(len(sets) * REGISTERS, np.inf)
    todo, horizon = np.flatnonzero(n), np.log(REGISTERS) + 8.0
    while len(todo):
        state = np.concatenate([sets[i] for i in todo])
        doc = np.repeat(todo, n[todo])
        limit = horizon / n[doc]
        time = np.zeros(len(doc))
        step = 0
        while len(doc):
            step = (step + 0x9E3779B97F4A7C15) % 2**64
            state = mix(state + np.uint64(step))
            time = time - np.log1p(-((state >> np.uint64(11)) * 2.0**-53)) / REGISTERS
            on = time <= limit
            state, doc, time, limit = state[on], doc[on], time[on], limit[on]
            np.minimum.at(first, doc * REGISTERS + (state & np.uint64(REGISTERS - 1)).astype(np.int64), time)
        open_ = np.isinf(first.reshape(-1, REGISTERS)[todo]).any(axis=1)
        todo, horizon = todo[open_], horizon * 2
    first = first.reshape(-1, REGISTERS)
    k = np.zeros(first.shape, np.int64)
    k[n > 0] = np.floor(1 - np.log(first[n > 0]) / np.log(BASE)).astype(np.int64)
    return (k & 255).astype(np.uint8)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 64) -> np.ndarray:
    """Similarity of greatest likelihood given how many registers are greater, smaller and equal, and both set sizes."""
    diff = (a - b).view(np.int8)
    more, less = (diff > 0).sum(axis=1), (diff < 0).sum(axis=1)
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, steps)[None]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p_more, p_less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    log = more[:, None] * np.log(p_more + tiny) + less[:, None] * np.log(p_less + tiny) + same[:, None] * np.log(np.maximum(1 - p_more - p_less, tiny))
    return np.take_along_axis(j, log.argmax(axis=1)[:, None], axis=1)[:, 0]


def id_or_key() -> F.Column:
    """doc_id, or for a row without one a key made from its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << 62) - 1)))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id or key, text, and which rows have no doc_id."""
    return doc_columns(docs).select(id_or_key().alias("doc_id"), "text", F.col("doc_id").isNull().alias("no_id"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id or key, n (set size), a 128-bit digest of the set (d1, d2), the registers, and whether there is no doc_id."""

    def run(batches):
        for batch in slices(batches, 2 << 20):
            sets = shingle_sets(Words(batch.column("text"), lower=True))
            regs = sketch(sets)
            with np.errstate(over="ignore"):
                d1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(as_long(d1)), pa.array(as_long(d2)), pa.array([r.tobytes() for r in regs], pa.binary()), batch.column("no_id")],
                ["doc_id", "n", "d1", "d2", "regs", "no_id"],
            )

    return keyed(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, regs binary, no_id boolean")


def band_rows(reps: DataFrame) -> DataFrame:
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * ROWS + 1, F.lit(ROWS))))
    return reps.select("rep", "prio", F.explode(keys).alias("key"))


def estimated(pairs: DataFrame, reps: DataFrame, least: float = ESTIMATE) -> DataFrame:
    """Candidate pairs (a, b) that the joint estimate and, with a least estimate, the sizes leave, with the estimate."""
    own = reps.select("rep", "n", "regs")
    both = pairs.join(own.toDF("a", "n_a", "r_a"), "a").join(own.toDF("b", "n_b", "r_b"), "b")
    if least > 0:
        both = both.where((DEN * F.col("n_a") >= NUM * F.col("n_b")) & (DEN * F.col("n_b") >= NUM * F.col("n_a")))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 4000):
                c = b.slice(k, 4000)
                r = [np.frombuffer(b"".join(c.column(x).to_pylist()), np.uint8).reshape(-1, REGISTERS) for x in ("r_a", "r_b")]
                est = joint_estimate(*r, c.column("n_a").to_numpy(), c.column("n_b").to_numpy()) if c.num_rows else np.zeros(0)
                on = np.flatnonzero(est >= least)
                yield pa.RecordBatch.from_arrays([c.column("a").take(pa.array(on)), c.column("b").take(pa.array(on)), pa.array(est[on], pa.float64())], ["a", "b", "estimate"])

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long, estimate double")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    texts = doc_columns(docs)
    both = pairs.select("a", "b").join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def run(batches):
        last, own = None, None
        for batch in slices(batches, 2 << 20, "text_b"):
            sets = shingle_sets(Words(batch.column("text_b"), lower=True))
            keep = []
            ids = batch.column("a").to_pylist()
            for i, a in enumerate(ids):
                if a != last:
                    last, own = a, shingle_sets(Words(batch.column("text_a").slice(i, 1), lower=True))[0]
                shared = len(np.intersect1d(own, sets[i], assume_unique=True))
                keep.append(DEN * shared >= NUM * (len(own) + len(sets[i]) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node and comp (smallest node reachable) by rounds of large-star and small-star.

    known: components (node, comp) of earlier edges, which then need not be walked again.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        e = e.unionByName(known.select(F.col("node").alias("u"), F.col("comp").alias("v")))
    e = materialize(e.where("u <> v").distinct(), "components")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the rows of a node with very many neighbours can be split in the join
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "components")
        # stars: every node has one edge, to a node that has none of its own
        tangled = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        if not tangled and not e.groupBy("u").count().where("count > 1").limit(1).count():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _shingle_rows(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, shingle of the documents named."""

    def run(batches):
        for batch in slices(batches, 2 << 20):
            sets = shingle_sets(Words(batch.column("text"), lower=True))
            doc = np.repeat(batch.column("doc_id").to_numpy(), [len(s) for s in sets])
            flat = as_long(np.concatenate(sets)) if len(sets) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(flat)], ["rep", "shingle"])

    return doc_columns(docs).join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(run, "rep long, shingle long")


def _outside(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """For pairs (a pivot, b a document): rep = b, how many shingles both have, and each shingle that b alone has (null: none)."""
    texts = doc_columns(docs)
    both = pairs.select("a", "b").join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def run(batches):
        last, own = None, None
        for batch in slices(batches, 2 << 20, "text_b"):
            sets = shingle_sets(Words(batch.column("text_b"), lower=True))
            shared, extra = [], []
            for i, a in enumerate(batch.column("a").to_pylist()):
                if a != last:
                    last, own = a, shingle_sets(Words(batch.column("text_a").slice(i, 1), lower=True))[0]
                rest = np.setdiff1d(sets[i], own, assume_unique=True)
                shared.append(len(sets[i]) - len(rest))
                extra.append(as_long(rest))
            yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(shared, pa.int64()), pa.array(extra, pa.list_(pa.int64()))], ["rep", "shared", "extra"])

    rows = both.select("a", "b", "text_a", "text_b").mapInArrow(run, "rep long, shared long, extra array<long>")
    return rows.select("rep", "shared", F.explode_outer("extra").alias("shingle"))


def _lead_pairs(left: DataFrame, links: DataFrame, reps: DataFrame, least: float = ESTIMATE) -> DataFrame:
    """Pairs (a, b, estimate): b in an unsettled bucket, a a leader of one of b's buckets, of another component.

    A bucket is led by the documents with the most links of LEADERS components.
    """
    degree = links.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    rank = F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.xxhash64("rep").alias("h"), F.col("rep").alias("lead"))
    best = left.join(degree, "rep", "left").groupBy("key", F.col("comp").alias("lead_comp")).agg(F.max(rank).alias("m"))
    w = Window.partitionBy("key").orderBy(F.desc("m"))
    top = best.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= LEADERS)
    # one row for each bucket, written, so that a hot bucket's rows can be split in the join
    leads = materialize(top.groupBy("key").agg(F.collect_list(F.struct("m.lead", "lead_comp")).alias("leads")), "leads")
    own = left.join(leads, "key").groupBy("rep", "comp").agg(F.flatten(F.collect_list("leads")).alias("leads"))  # BANDS * LEADERS at most
    other = F.transform(F.filter("leads", lambda x: x["lead_comp"] != F.col("comp")), lambda x: x["lead"])
    own = own.select(F.col("rep").alias("b"), other.alias("leads"))
    ranked = F.transform(F.array_distinct("leads"), lambda a: F.struct((-F.size(F.filter("leads", lambda x: x == a))).alias("times"), a.alias("a")))
    met = own.select("b", F.explode(F.slice(F.array_sort(ranked), 1, MEETINGS)).alias("m")).select("m.a", "b")
    return estimated(met, reps, least)


def _most_met(met: DataFrame) -> DataFrame:
    """Of rows (a, b), one for each bucket in common, the distinct pairs of each b with the a met most often, MEETINGS at most.

    This only chooses whom to compare first; what it leaves out is compared exactly later.
    """
    counts = met.groupBy("a", "b").agg(F.count("*").alias("times"))
    w = Window.partitionBy("b").orderBy(F.desc("times"), "a")
    return counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= MEETINGS).select("a", "b")


def _candidates(left: DataFrame, links: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in one unsettled bucket that may be linked; none is left out.

    A document's pivot is the leader of another component most similar by estimate. What it shares with a partner
    is at most what it shares with its pivot, its other shingles that are common in other components, and of the
    rest those that the partner has. Where the first two are under 3/7 of both sizes, the pair is found by the
    rest, from the side of the smaller component if both sides are so; a shingle of the rest meets fewer than
    2 * COMMON documents. Other pairs are found by their bucket.
    """
    nearest = _lead_pairs(left, links, reps, 0.0).groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a"))
    who = materialize(left.select("rep", "comp").distinct(), "unsettled")
    beyond = _outside(nearest, docs).join(who, "rep")
    every = materialize(_shingle_rows(who.select("rep"), docs).join(who, "rep"), "shingles")
    inside = materialize(every.groupBy("shingle", "comp").agg(F.count("*").alias("own")), "inside")
    # common: in COMMON documents of other components; where a shingle has so many, at most one component has all but fewer
    totals = inside.groupBy("shingle").agg(F.sum("own").alias("total"), F.max(F.struct("own", F.col("comp").alias("of"))).alias("top"))
    often = materialize(totals.where(F.col("total") >= 2 * COMMON), "often")
    but = (F.col("top.of") == F.col("comp")) & (F.col("total") - F.col("top.own") < COMMON)
    common = F.when(F.col("total").isNotNull() & ~but, F.lit(1))
    beyond = beyond.join(often, "shingle", "left").withColumn("common", common)
    beyond = materialize(beyond.select("rep", "shared", "shingle", "comp", "common"), "pivots")

    size = who.groupBy("comp").agg(F.count("*").alias("size"))
    shared = beyond.groupBy("rep").agg((F.max("shared") + F.count("common")).alias("shared"))
    info = who.join(size, "comp").join(reps.select("rep", "n"), "rep").join(shared, "rep")
    info = materialize(info.select("rep", "comp", "n", "shared", "size"), "unsettled")
    mine = beyond.where("shingle is not null and common is null").select("rep", "shingle").join(info, "rep").toDF("a", "shingle", "c_a", "n_a", "shared_a", "size_a")
    other = every.select("rep", "shingle").join(info, "rep").toDF("b", "shingle", "c_b", "n_b", "shared_b", "size_b")
    short_a, short_b = "7 * shared_a < 3 * (n_a + n_b)", "7 * shared_b < 3 * (n_a + n_b)"
    from_a = F.expr(f"c_a <> c_b and {short_a} and (not ({short_b}) or size_a < size_b or (size_a = size_b and c_a < c_b))")
    met = mine.join(other, "shingle").where(from_a).groupBy("a", "b", "n_a", "n_b", "shared_a").agg(F.count("*").alias("extra"))
    by_shingle = met.where("7 * (shared_a + extra) >= 3 * (n_a + n_b)").select("a", "b")

    # pairs of which no side is short: partners of n <= most for both, found by the rarest quarter of their shingles
    able = info.select("rep", "comp", "n", F.floor(7 * F.col("shared") / 3 - F.col("n")).alias("most")).where("4 * most >= 3 * n")
    bound = left.select("key", "rep").join(able, "rep").groupBy("key").agg(F.min("n").alias("least"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2")
    alone = left.select("key", "rep").join(bound, "key").groupBy("rep").agg(F.min("least").alias("least"))
    able = materialize(able.join(alone, "rep").where("most >= least").drop("least"), "unsettled")
    rare = materialize(_rarest(every.select("rep", "shingle").join(able, "rep"), able.count()), "rarest")
    x, y = rare.toDF("shingle", "a", "c_a", "n_a", "most_a"), rare.toDF("shingle", "b", "c_b", "n_b", "most_b")
    fits = (F.col("c_a") < F.col("c_b")) & (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    sizes = (4 * F.col("n_a") >= 3 * F.col("n_b")) & (4 * F.col("n_b") >= 3 * F.col("n_a"))
    return by_shingle.unionByName(x.join(y, "shingle").where(fits & sizes).select("a", "b")).distinct()


def _rarest(rows: DataFrame, documents: int) -> DataFrame:
    """Of each document's shingles the n - ceil(3/4 n) + 1 that fewest of the given documents have.

    A partner has three quarters of them at least, so it has one of these, and the same order makes it one of its own as well.
    """
    # the documents of one shingle go through the join a block of rows at a time, and are dealt evenly after it
    blocks = documents // BLOCK_ROWS + 1
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).alias("block")
    lists = materialize(rows.groupBy("shingle", block).agg(F.collect_list(F.struct("rep", "comp", "n", "most")).alias("who")), "lists")
    often = materialize(lists.groupBy("shingle").agg(F.sum(F.size("who")).alias("docs")).where("docs > 1"), "often")
    met = lists.join(often, "shingle").hint("rebalance").select("shingle", "docs", F.explode("who").alias("w")).select("shingle", "docs", "w.*")
    # shingles that no other document has come first
    w = Window.partitionBy("rep")
    nth = F.row_number().over(w.orderBy("docs", "shingle")) + F.col("n") - F.count("*").over(w)
    return met.withColumn("nth", nth).where("nth <= floor(n / 4) + 1").select("shingle", "rep", "comp", "n", "most")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    kept = F.col("key") == F.col("component_id")
    return _judged(docs).select(F.when(~F.col("no_id"), F.col("key")).alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def _judged(docs: DataFrame) -> DataFrame:
    """key (doc_id, or that of a row without one), no_id, n_shingles, component_id."""
    base = materialize(sketches(docs), "sketches")
    groups = base.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("no_id", "doc_id", "n", "regs")).alias("m"), F.count("*").alias("copies"))
    # leaders are the most copied texts; a hash breaks ties
    prio = F.least("copies", F.lit(1 << 18)) * F.lit(1 << 44) + F.xxhash64("m.doc_id").bitwiseAND(F.lit((1 << 44) - 1))
    reps = materialize(groups.select("d1", "d2", F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"), F.col("m.regs").alias("regs"), prio.alias("prio")), "reps")
    comps = _components(reps, keyed(docs))
    of_set = reps.select("d1", "d2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("comp", "rep").alias("comp"))
    own = base.select(F.col("doc_id").alias("key"), "no_id", F.col("n").alias("n_shingles"), "d1", "d2")
    out = own.where("n_shingles > 0").join(of_set, ["d1", "d2"]).select("key", "no_id", "n_shingles", F.col("comp").alias("component_id"))
    return out.unionByName(own.where("n_shingles = 0").select("key", "no_id", "n_shingles", F.col("key").alias("component_id")))


def _components(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """node, comp of the representatives that are linked with another."""
    rows = band_rows(reps)
    buckets = rows.groupBy("key").agg(F.max_by("rep", "prio").alias("lead"), F.count("*").alias("many")).where("many > 1").select("key", "lead")
    shared = materialize(rows.join(buckets, "key").select("key", "rep", "lead"), "buckets")
    # from here on only the texts of documents that share a bucket are read
    docs = materialize(doc_columns(docs).join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")

    # each document against the best of its buckets' leaders
    met = shared.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    best = estimated(_most_met(met), reps).groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a"))
    links = materialize(confirmed(best, docs), "links")
    comps = components(links)

    # buckets that are still of several components, against the members of most links
    more = materialize(confirmed(_lead_pairs(_unsettled(shared, comps), links, reps), docs), "links")
    comps = components(more, comps)
    links = links.unionByName(more)

    # and the rest of each such bucket exactly
    rest = _candidates(_unsettled(shared, comps), links, reps, docs)
    return components(confirmed(estimated(rest, reps), docs), comps)


def _unsettled(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """key, rep, comp of buckets that hold more than one component."""
    own = shared.select("key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    several = own.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key")
    return materialize(own.join(several, "key", "left_semi"), "unsettled")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns."""
    gone = _judged(docs).where("n_shingles > 0 and key <> component_id").select(F.col("key").alias("gone"))
    # the row stays in one struct, so that its columns' names never clash; repeated rows of one doc_id stay or go together
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    known = docs.where("doc_id is not null").select(row, F.col("doc_id").cast("long").alias("key")).join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")
    # without doc_id, rows of one text have one key; texts without words are linked with nothing
    worded = F.coalesce(F.col("text").cast("string").rlike("[^\\t-\\r ]"), F.lit(False))
    rest = docs.where("doc_id is null").select(row, id_or_key().alias("key"), F.when(~worded, F.monotonically_increasing_id()).alias("own"))
    rest = rest.join(gone, (F.col("key") == F.col("gone")) & F.col("own").isNull(), "left_anti").groupBy("key", "own").agg(F.first("row").alias("row")).select("row.*")
    return known.union(rest)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
