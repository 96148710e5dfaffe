"""Benchmark decontamination by an FM-index of each training shard.

A shard is the words of one slice of documents. Words outside the phrases' alphabet become separators
and runs shorter than the shortest phrase are left out, which no phrase can span, so the index stays
small without losing an occurrence. Phrases are searched backward with wavelet-tree ranks, occurrences
are located by sampled suffix positions, and spans of hit words are merged.

Defined results: a null, empty or wordless document has no words and no hits; a null or wordless item
has no phrase; repeated items and repeated documents are each judged alone; no benchmark rows: no hits.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, doc_columns, materialize, slices, table

WORD_GAP = np.ones(256, bool)
WORD_GAP[0x30:0x3A] = WORD_GAP[0x41:0x5B] = WORD_GAP[0x61:0x7B] = WORD_GAP[0x80:] = False
RUN = 13
#: Phrases in one broadcast block; a larger benchmark is searched block by block.
BLOCK_PHRASES = 200_000


class WaveletTree:
    """Levels of bits, most significant first, each stably split into zeros and ones; ranks by counts."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.bits = len(symbols), max(1, int(sigma - 1).bit_length())
        self.zeros, self.ranks = [], []
        level = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before position i; vectorised over both."""
        low, high = np.zeros_like(i), i.copy()
        for d, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            r_low, r_high = self.ranks[d][low], self.ranks[d][high]
            low = np.where(one, self.zeros[d] + r_low, low - r_low)
            high = np.where(one, self.zeros[d] + r_high, high - r_high)
        return high - low

    def access(self, i: np.ndarray) -> np.ndarray:
        value, i = np.zeros_like(i), i.copy()
        for d in range(self.bits):
            r = self.ranks[d]
            bit = r[i + 1] - r[i]
            i = np.where(bit == 1, self.zeros[d] + r[i], i - r[i])
            value = value * 2 + bit
        return value


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; text ends in a unique smallest symbol."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], text[order][1:] != text[order][:-1]]))
    k = 1
    while rank.max() < n - 1:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        # only groups that are still tied need sorting again
        order_key = key[order]
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank[order]] > 1)
        order[tied] = order[tied][np.argsort(order_key[tied], kind="stable")]
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        k *= 2
    return order


class FMIndex:
    """text: symbols from 1 up, 0 only as the last. Every sample-th text position is kept for locating."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        sa = suffix_array(text)
        self.n, self.sample = len(text), sample
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletTree(text[sa - 1], sigma)
        self.marked = sa % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.places = sa[self.marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases (padded at the right, symbols) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            on = np.flatnonzero((back < lengths) & (high > low))
            if not len(on):
                break
            c = phrases[on, lengths[on] - 1 - back]
            low[on] = self.first[c] + self.tree.rank(c, low[on])
            high[on] = self.first[c] + self.tree.rank(c, high[on])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marked[rows[open_]]
            done = open_[hit]
            out[done] = self.places[self.mark_rank[rows[done]]] + steps[done]
            open_ = open_[~hit]
            c = self.tree.access(rows[open_])
            rows[open_] = self.first[c] + self.tree.rank(c, rows[open_])
            steps[open_] += 1
        return out


class Phrases:
    """Distinct windows of the benchmark's items over an alphabet of their words."""

    def __init__(self, item_ids: list[str], texts: list[str | None], run: int = RUN):
        words = Words(pa.array([t or "" for t in texts], pa.string()), lower=True, space=WORD_GAP)
        self.alphabet, codes = np.unique(words.hash, return_inverse=True)
        codes = codes.astype(np.int64) + 2  # 0 ends the text, 1 separates
        found: dict[bytes, int] = {}
        rows, lengths, self.items = [], [], []
        for i, item in enumerate(item_ids):
            own = codes[words.doc_off[i] : words.doc_off[i + 1]]
            if not len(own):
                continue
            size = min(run, len(own))
            for s in range(len(own) - size + 1):
                w = own[s : s + size]
                k = found.setdefault(w.tobytes(), len(rows))
                if k == len(rows):
                    rows.append(np.pad(w, (0, run - size)))
                    lengths.append(size)
                    self.items.append(set())
                self.items[k].add(item)
        self.rows = np.array(rows, np.int64).reshape(-1, run)
        self.lengths = np.array(lengths, np.int64)
        self.shortest = int(self.lengths.min(initial=run))


def find(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in the shard: phrase, first word (index into words), one past the last word."""
    empty = np.zeros(0, np.int64)
    if not len(phrases.rows) or not len(words.hash):
        return empty, empty, empty
    at = np.searchsorted(phrases.alphabet, words.hash)
    at[at == len(phrases.alphabet)] = 0
    known = phrases.alphabet[at] == words.hash
    # runs of known words within a document
    edge = np.zeros(len(known) + 1, bool)
    edge[words.doc_off] = True
    begins = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long_enough = ends - begins >= phrases.shortest
    begins, ends = begins[long_enough], ends[long_enough]
    if not len(begins):
        return empty, empty, empty
    sizes = ends - begins
    out_start = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.ones(out_start[-1] + 1, np.int64)
    place = np.full(len(text), -1, np.int64)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    to, source = np.repeat(out_start[:-1], sizes) + within, np.repeat(begins, sizes) + within
    text[to] = at[source] + 2
    place[to] = source
    text[-1] = 0
    index = FMIndex(text, len(phrases.alphabet) + 2)
    low, high = index.search(phrases.rows, phrases.lengths)
    hits = high - low
    phrase = np.repeat(np.arange(len(hits)), hits)
    rows = np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
    first = place[index.locate(rows)]
    return phrase, first, first + phrases.lengths[phrase]


def _ddl(key: str) -> str:
    return f"{key} long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _schema(key: str) -> pa.Schema:
    return pa.schema([(key, pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, run: int):
    """Phrases of the benchmark, in blocks of about BLOCK_PHRASES windows; one empty block for an empty benchmark."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    ids, texts, size, any_ = [], [], 0, False
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text) // 4 + 1
        if size >= BLOCK_PHRASES:
            yield Phrases(ids, texts, run)
            ids, texts, size, any_ = [], [], 0, True
    if ids or not any_:
        yield Phrases(ids, texts, run)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, run: int = RUN) -> DataFrame:
    """One row for each row of docs: words, merged spans of hit words (word positions) and the items found.

    Several blocks are searched one after another, over rows with a number of their own by which their spans are merged.
    """
    first, blocks = _several(_blocks(benchmark, run))
    if blocks is None:
        return _search(doc_columns(docs), first, "doc_id")[0]
    rows = materialize(doc_columns(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    return rows.select("row", "doc_id").join(_merged(rows, blocks), "row").select("doc_id", "n_words", "spans", "items")


def _several(blocks):
    """The only block and nothing, or nothing and all blocks."""
    first, second = next(blocks), next(blocks, None)
    return (first, None) if second is None else (None, chain([first, second], blocks))


def _merged(rows: DataFrame, blocks) -> DataFrame:
    """row, n_words, spans and items over all blocks; each is sent, searched, written and released before the next."""
    found = None
    for phrases in blocks:
        part, sent = _search(rows, phrases, "row")
        part = materialize(part, "block")
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    grouped = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merged(batches):
        for b in batches:
            own = b.to_pylist()
            for r in own:
                r["spans"] = [{"start": x, "end": y} for x, y in merge([(s["start"], s["end"]) for s in r["spans"]])]
                r["items"] = sorted(r["items"])
            yield pa.RecordBatch.from_pylist(own, _schema("row"))

    return grouped.mapInArrow(merged, _ddl("row"))


def _hits(batch: pa.RecordBatch, phrases: Phrases) -> tuple[np.ndarray, list, list]:
    """Words, merged spans and items of each document of a batch."""
    words = Words(batch.column("text"), lower=True, space=WORD_GAP)
    phrase, first, end = find(words, phrases)
    doc = np.searchsorted(words.doc_off, first, side="right") - 1
    spans: dict[int, set] = {}
    items: dict[int, set] = {}
    for d, k, a, b in zip(doc.tolist(), phrase.tolist(), first.tolist(), end.tolist(), strict=True):
        base = int(words.doc_off[d])
        spans.setdefault(d, set()).add((a - base, b - base))
        items.setdefault(d, set()).update(phrases.items[k])
    n = range(batch.num_rows)
    return words.count().astype(np.int64), [merge(list(spans.get(i, ()))) for i in n], [sorted(items.get(i, ())) for i in n]


def _search(docs: DataFrame, phrases: Phrases, key: str):
    """key, n_words, spans and items of each row, and the phrases as they were sent."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    schema = _schema(key)

    def scan(batches):
        for batch in slices(batches):
            n_words, spans, items = _hits(batch, sent.value)
            spans = pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], schema.field("spans").type)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n_words), spans, pa.array(items, schema.field("items").type)], schema=schema)

    return docs.select(key, "text").mapInArrow(scan, _ddl(key)), sent


def judge(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and the verdict from spans: hit, and at least a twentieth of the words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, run: int = RUN) -> DataFrame:
    """Documents that the rule doesn't call contaminated, with all their columns.

    Where the benchmark is one block, the verdict is taken as the row passes, without a shuffle; else rows get numbers and are joined by them.
    """
    first, blocks = _several(_blocks(benchmark, run))
    if blocks is not None:
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
        rows = materialize(docs.select(whole, F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "rows")
        bad = judge(_merged(rows, blocks).withColumnRenamed("row", "doc_id")).where("contaminated").select(F.col("doc_id").alias("row"))
        return rows.join(bad, "row", "left_anti").select("whole.*")
    sent = docs.sparkSession.sparkContext.broadcast(first)

    def keep(batches):
        for batch in slices(batches):
            n_words, spans, _ = _hits(batch, sent.value)
            n_hit = np.array([sum(b - a for a, b in own) for own in spans], np.int64)
            yield batch.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

    return docs.mapInArrow(keep, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
