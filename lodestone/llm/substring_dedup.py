"""Substring dedup by suffix automata over shards of repeated passages.

A word goes if a window of WINDOW consecutive words covers it whose sequence also starts in a document of
smaller doc_id. Anchors (runs of GRAM words that are least by hash in some window, so that every window
holds one and equal windows hold equal ones) find where documents may share a window. An anchor's context
is all its windows; a context that is equal in an earlier document is removed without further search. What
is left are distinct passages. They are put into shards by the first document of their anchor: two passages
with a common window share an anchor, hence a shard. Within a shard documents are streamed in order of
doc_id through the suffix automaton of those before, whose matching statistics give the maximal spans; only
new windows are added to it. A shard's automaton is built where its passages are, never larger than
SHARD_WORDS; passages of an anchor with more (one passage in very many texts) are told apart by
window hashes instead, which any number of tasks can share. Texts equal to one of a smaller doc_id (by SHA-256)
go whole and are left out of all this: every window of theirs starts in that document. Contexts and windows are
told apart by two independent 64-bit hashes together.

Defined results: null and empty texts have no words; a text of fewer than WINDOW words loses nothing;
rows that repeat a doc_id are one document and never remove each other's words, whether their texts are equal or not;
rows without doc_id lose nothing and remove nothing; the digest of nothing kept is that of the empty string; columns
beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_long, doc_columns, gram_hashes, materialize, mix, powers, slices, table

WINDOW, GRAM = 50, 16
REACH = WINDOW - GRAM  # words of a window that may stand before its anchor
SHARD_WORDS = 60_000
#: Places of one gram or context in one list, about.
LIST_PLACES = 256


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width] for each i, by doubling."""
    done, size = x, 1
    while size * 2 <= width:
        done = pick(done[: len(done) - size], done[size:])
        size *= 2
    rest = width - size
    return pick(done[: len(done) - rest], done[rest:]) if rest else done


_SECOND = np.uint64(0x94D049BB133111EB)


def anchors(words: Words) -> tuple[np.ndarray, ...]:
    """Document index, position in the document, gram hash and two context hashes of every anchor."""
    h, off = words.hash, words.doc_off
    if len(h) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, *(none.view(np.uint64) for _ in range(3))
    g = gram_hashes(h, GRAM)
    least = _slide(g, REACH + 1, np.minimum)  # one for each window start
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = doc[: len(least)] == doc[WINDOW - 1 : WINDOW - 1 + len(least)]
    # a gram is an anchor if it is the least of some window within one document
    bound = np.where(whole, least, np.uint64(0))
    pad = np.zeros(REACH, np.uint64)
    highest = _slide(np.concatenate([pad, bound, pad]), REACH + 1, np.maximum)[: len(g)]
    at = np.flatnonzero((highest == g) & (highest > 0))
    d = doc[at]
    low = np.maximum(at - REACH, off[d])
    high = np.minimum(at + WINDOW, off[d + 1])
    up, down = powers(0xC2B2AE3D27D4EB4F, len(h) + 1)
    shape = mix(((at - low) * 128 + (high - at)).astype(np.uint64) + np.uint64(1))
    contexts = []
    for own in (h, mix(h + _SECOND)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(own * up[: len(h)], out=total[1:])
        contexts.append(mix((total[high] - total[low]) * down[low] + shape))
    return d, at - off[d], g[at], *contexts


_ANCHOR = pa.list_(pa.struct([("pos", pa.int32()), ("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())]))


def anchor_lists(base: DataFrame) -> DataFrame:
    """doc_id, digest, text_key and anchors of each text."""

    def run(batches):
        for batch in slices(batches):
            d, pos, g, c1, c2 = anchors(Words(batch.column("text")))
            off = np.searchsorted(d, np.arange(batch.num_rows + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), *(pa.array(as_long(x)) for x in (g, c1, c2))], fields=list(_ANCHOR.value_type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "text_key")), pa.ListArray.from_arrays(pa.array(off), rows)], ["doc_id", "digest", "text_key", "anchors"])

    return base.mapInArrow(run, "doc_id long, digest binary, text_key long, anchors array<struct<pos:int,gram:long,c1:long,c2:long>>")


def merge_spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint spans that cover the same positions."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    return low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]


class SuffixAutomaton:
    """Of a growing sequence of word hashes; passages are set apart by symbols that occur once."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.breaks = 0, 0

    def _extend(self, c) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, words: list) -> None:
        self.breaks += 1
        self._extend(("break", self.breaks))
        for c in words:
            self._extend(c)

    def statistics(self, words: list) -> np.ndarray:
        """At each word, the length of the longest run ending there that occurs in the automaton."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        out = np.zeros(len(words), np.int64)
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            out[i] = n
        return out


def shard_spans(units: pa.Table) -> list[tuple[int, int, int, int]]:
    """Removed spans (doc_id, text_key, start, end) of one shard: its passages by document, in order of doc_id."""
    out = []
    order = units.sort_by([("lead", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
    leads, docs, keys, starts, blobs = (order.column(c) for c in ("lead", "doc_id", "text_key", "start", "words"))
    leads, docs, keys, starts = leads.to_pylist(), docs.to_pylist(), keys.to_pylist(), starts.to_pylist()
    automaton, lead, k = SuffixAutomaton(), None, 0
    while k < len(docs):
        if leads[k] != lead:
            automaton, lead = SuffixAutomaton(), leads[k]
        own, doc = [], docs[k]
        while k < len(docs) and docs[k] == doc and leads[k] == lead:
            own.append((keys[k], starts[k], np.frombuffer(blobs[k].as_py(), np.int64).tolist()))
            k += 1
        fresh = []
        for key, start, words in own:
            ends = np.arange(WINDOW - 1, len(words))
            seen = automaton.statistics(words)[WINDOW - 1 :] >= WINDOW
            low, high = merge_spans(ends[seen] - WINDOW + 1, ends[seen] + 1)
            out += [(doc, key, start + a, start + b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            low, high = merge_spans(ends[~seen] - WINDOW + 1, ends[~seen] + 1)
            fresh += [words[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        if k < len(docs) and leads[k] == lead:
            for words in fresh:
                automaton.add(words)
    return out


def _kept(raw: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[int, bytes]:
    removed = int((high - low).sum())
    if not removed:
        return 0, b" ".join(raw)
    mask = np.ones(len(raw), bool)
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        mask[a:b] = False
    return removed, b" ".join([raw[i] for i in np.flatnonzero(mask).tolist()])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("text_key", pa.int64())])
_SPAN = pa.list_(pa.int64())
_PARTS = pa.schema([("kind", pa.int32()), *_OUT, ("text", pa.string()), ("low", _SPAN), ("high", _SPAN), ("lead", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])
_OUT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, text_key long"
_PARTS_DDL = f"kind int, {_OUT_DDL}, text string, low array<long>, high array<long>, lead long, start long, words binary"
_DONE, _OPEN, _UNIT = 0, 1, 2


def _row(doc: int, key: int, text: str | None, low: np.ndarray, high: np.ndarray, texts: bool) -> dict:
    raw = (text or "").encode().split()
    removed, kept = _kept(raw, low, high)
    return {"doc_id": doc, "n_words": len(raw), "n_removed": removed, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode() if texts and removed else None, "text_key": key}


def text_key() -> F.Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and the kept text of changed ones if asked for."""
    base = doc_columns(docs).withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).withColumn("text_key", text_key())
    # the first document of each text
    lists = anchor_lists(base.where("doc_id is not null")).groupBy("digest", "text_key").agg(F.min_by(F.struct("doc_id", "anchors"), "doc_id").alias("m"), F.max("doc_id").alias("last"))
    firsts = materialize(lists.select("digest", "text_key", "m.doc_id", "m.anchors", "last"), "anchors")
    copied = materialize(firsts.where("doc_id < last").select("digest", F.col("doc_id").alias("first")), "copied")
    copies = base.select("doc_id", "text_key", "digest").join(copied, "digest").where("first < doc_id").select("doc_id", "text_key").distinct()
    found = firsts.select("doc_id", "text_key", F.explode("anchors").alias("a")).select("doc_id", "text_key", "a.*")
    # grams of two documents or more, with the first of them; written, so that a hot gram's rows can be split in the join
    grams = materialize(found.groupBy("gram").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("gram", "lead"), "grams")
    # the places of one gram go through the join in lists of about LIST_PLACES, and are dealt evenly after it;
    # a gram may have many places in one document, so places are dealt, not documents
    n_places = firsts.agg(F.sum(F.greatest(F.size("anchors"), F.lit(0)))).first()[0] or 0
    salt = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(n_places // LIST_PLACES + 1)).alias("salt")
    lists = found.groupBy("gram", salt).agg(F.collect_list(F.struct("doc_id", "text_key", "pos", "c1", "c2")).alias("rows"))
    shared = lists.join(grams, "gram").hint("rebalance").select("lead", F.explode("rows").alias("r")).select("r.*", "lead")
    shared = materialize(shared, "shared")
    # contexts of two documents or more; written as well, for the same reason
    contexts = materialize(shared.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("c1", "c2", "first"), "contexts")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    # the same for the places of one context
    lists = shared.groupBy("c1", "c2", salt).agg(F.collect_list(F.struct("doc_id", "text_key", "pos", "lead")).alias("rows"))
    marked = lists.join(contexts, ["c1", "c2"], "left").hint("rebalance").select("first", F.explode("rows").alias("r")).select("r.*", "first")
    marked = marked.select("doc_id", "text_key", F.struct("pos", "lead", copy.alias("copy")).alias("a"))
    places = marked.groupBy("doc_id", "text_key").agg(F.collect_list("a").alias("anchors")).withColumn("whole", F.lit(False))
    places = places.unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True)

    def split(batches):
        none = np.zeros(0, np.int64)
        rows, held = [], 0
        for batch in slices(batches, 2 << 20):
            lists = batch.column("anchors")
            plain = np.asarray(lists.is_null())
            whole = np.asarray(batch.column("whole").fill_null(False))
            ids, keys, texts_ = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))
            words = Words(batch.column("text"))
            count = words.count()
            for i, doc in enumerate(ids):
                if held > 8 << 20 or len(rows) > 4000:  # one document may have many passages
                    yield pa.RecordBatch.from_pylist(rows, _PARTS)
                    rows, held = [], 0
                if plain[i]:
                    # a copy of an earlier document, or a text that shares nothing
                    gone = (none, none) if not whole[i] or count[i] < WINDOW else (np.zeros(1, np.int64), count[i : i + 1])
                    rows.append({"kind": _DONE, **_row(doc, keys[i], texts_[i], *gone, texts)})
                    continue
                a = lists[i].values
                pos, lead, copy = (np.asarray(a.field(k)).astype(np.int64) for k in range(3))
                low, high = np.maximum(pos - REACH, 0), np.minimum(pos + WINDOW, count[i])
                is_copy = copy == 1
                gone = merge_spans(low[is_copy], high[is_copy])
                if (lead[~is_copy] < doc).any():
                    rows.append({"kind": _OPEN, "doc_id": doc, "text_key": keys[i], "text": texts_[i], "low": gone[0].tolist(), "high": gone[1].tolist()})
                    held += len(texts_[i])
                else:
                    rows.append({"kind": _DONE, **_row(doc, keys[i], texts_[i], *gone, texts)})
                own = as_long(words.hash[words.doc_off[i] : words.doc_off[i + 1]])
                for m in np.unique(lead[~is_copy]).tolist():
                    on = ~is_copy & (lead == m)
                    for s, e in zip(*(x.tolist() for x in merge_spans(low[on], high[on])), strict=True):
                        rows.append({"kind": _UNIT, "lead": m, "doc_id": doc, "text_key": keys[i], "start": s, "words": own[s:e].tobytes()})
                        held += 8 * (e - s)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _PARTS)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _PARTS)

    both = ["doc_id", "text_key"]
    parts = materialize(base.drop("digest").join(places, both, "left").mapInArrow(split, _PARTS_DDL), "parts")
    # rows that repeat a document have the same passages
    units = parts.where(F.col("kind") == _UNIT).select("lead", *both, "start", "words").dropDuplicates(["lead", *both, "start"])
    by_doc = _searched(units).groupBy(*both).agg(F.collect_list(F.struct("low", "high")).alias("more"))
    open_ = parts.where(F.col("kind") == _OPEN).select(*both, "text", "low", "high").join(by_doc, both, "left")

    def finish(batches):
        for batch in slices(batches):
            rows = []
            for i, (doc, key) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), strict=True)):
                low, high = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("low", "high"))
                more = batch.column("more")[i]
                if more.is_valid:
                    low, high = (np.concatenate([x, np.asarray(more.values.field(k))]) for k, x in enumerate((low, high)))
                rows.append(_row(doc, key, batch.column("text")[i].as_py(), *merge_spans(low, high), texts))
            yield pa.RecordBatch.from_pylist(rows, _OUT)

    done = parts.where(F.col("kind") == _DONE).select(*_OUT.names)
    return done.unionByName(open_.mapInArrow(finish, _OUT_DDL))


def _searched(units: DataFrame) -> DataFrame:
    """Removed spans (doc_id, text_key, low, high) of passages, by automata or, for very large leads, by window hashes."""
    n_words = F.length("words") / 8
    weight = units.groupBy("lead").agg(F.sum(n_words).alias("weight"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1")
    weight = materialize(weight.select("lead", "weight"), "weights")
    total = weight.where(F.col("weight") <= SHARD_WORDS).agg(F.sum("weight")).first()[0] or 0
    shards = max(1, int(total // SHARD_WORDS) + 1)
    both = units.join(weight, "lead")
    spans = "doc_id long, text_key long, low long, high long"

    def search(shard):
        rows = shard_spans(shard)
        return pa.table({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("doc_id", "text_key", "low", "high"))})

    few = both.where(F.col("weight") <= SHARD_WORDS).select("lead", "doc_id", "text_key", "start", "words", F.pmod(F.xxhash64("lead"), F.lit(shards)).alias("shard"))
    by_automata = few.groupBy("shard").applyInArrow(search, spans)

    def windows(batches):
        names = ["doc_id", "text_key", "low", "w1", "w2"]
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            for doc, key, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "start")), batch.column("words"), strict=True):
                own = np.frombuffer(raw.as_py(), np.uint64)
                h, h2 = gram_hashes(own, WINDOW), gram_hashes(mix(own + _SECOND), WINDOW)
                for part, x in zip(parts, (np.full(len(h), doc), np.full(len(h), key), start + np.arange(len(h)), as_long(h), as_long(h2)), strict=True):
                    part.append(x)
                held += len(h)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), pa.int64()) for p in parts], names)
                    parts, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), pa.int64()) for p in parts], names)

    many = both.where(F.col("weight") > SHARD_WORDS).select("doc_id", "text_key", "start", "words").mapInArrow(windows, "doc_id long, text_key long, low long, w1 long, w2 long")
    many = materialize(many, "windows")
    first = materialize(many.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first"), "first")
    by_hash = many.join(first, ["w1", "w2"]).where("first < doc_id").select("doc_id", "text_key", "low", (F.col("low") + WINDOW).alias("high"))
    return by_automata.unionByName(by_hash)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out; untouched texts stay as they are."""
    changed = dedup(docs, texts=True).where("n_removed > 0").select("doc_id", "text_key", "kept")
    # rows that repeat a document get one text each
    changed = changed.groupBy("doc_id", "text_key").agg(F.first("kept").alias("kept"))
    # all columns in one, so that no name clashes
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    text = F.coalesce("kept", F.col("row.text").cast("string"))
    out = rows.join(changed, ["doc_id", "text_key"], "left").select(*(F.col(f"row.`{c}`") if c not in ("text", "n_chars") else text.alias("text") if c == "text" else F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType).alias("n_chars") for c in docs.columns))
    return out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept", "text_key")
