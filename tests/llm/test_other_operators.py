import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import chat, media, packing, tokens
from lodestone.llm import decontamination as dc
from lodestone.llm import token_counts as tc
from lodestone.llm.common import tokenizer_path

ODD = [None, "", " \n", "one", "<|endoftext|> a<|endoftext|>b", "don't A!'s é ̈x\x85y İstanbul", "word " * 9000, "Zeile.\n" * 50, "one"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(tokens.WORD_TOKENIZER))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(reference):
    ids, sizes, _ = tokens.WordEncoder(cache_pieces=3).encode(pa.array([t or "" for t in ODD]))
    assert sizes.tolist() == [len(reference(t)) for t in ODD]
    assert ids.tolist() == [i for t in ODD for i in reference(t)]


def test_pieces_rebuild_every_document(frame, reference):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(frame(ODD)).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and r.length == len(r.ids) // 4 > 0
    for i, t in enumerate(ODD):
        own, at = sorted(by_doc[i], key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(reference(t)) + 1
            at += r.length
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == [*reference(t), 2]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two


def test_packing_of_nothing(frame):
    assert packing.pack(frame(ODD).where("doc_id < 0")).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array([(i, j) for i in range(16) for j in range(16)])
    order = np.argsort(packing.hilbert_key(grid, 4))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_context_limits(frame, reference):
    lengths = [len(reference(t)) for t in ODD]
    rows = {r.n_tokens: r for r in tc.context_limits(tc.length_histogram(tc.encoded_lengths(frame(ODD)))).collect()}
    assert sorted(rows) == sorted(set(lengths))
    for limit, r in rows.items():
        assert r.n_docs == lengths.count(limit) and r.docs_at_least == sum(n >= limit for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= limit) and r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert r.lost_tokens == sum(lengths) - r.truncated_tokens and r.quantile == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    assert tc.context_limits(tc.length_histogram(tc.encoded_lengths(frame(ODD).where("doc_id < 0")))).count() == 0


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media_round_trip(frame, form):
    texts = [*ODD, "x" * 64, "x" * 65]
    for r in media.text_media(frame(texts), form).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert media.decode(bytes(r.media)).tobytes() == payload and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert len(r.feature) == 16


def test_images():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (5, 7), (3, 64), (4, 6, 3)):
        im = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_pnm(im)) == im).all() and (media.decode(media.encode_bmp(im)) == im).all()
    assert media.decode(b"P2 # note\n2 1 255\n7 9").tolist() == [[7, 9]]
    assert np.allclose(media.area_resize(np.arange(36.0).reshape(6, 6), 3, 3), np.arange(36.0).reshape(3, 2, 3, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(np.ones((5, 7)), 3, 2), 1)


def test_undecodable_media(spark):
    df = spark.createDataFrame([(bytearray(b"P5\n2 1\n255\nab"),), (bytearray(b"junk"),), (None,)], "media binary")
    assert [r.h for r in media.decode_media(df).selectExpr("decoded.height as h").collect()] == [1, None, None]


def test_images_without_samples_and_of_16_bits(spark):
    bad = [b"P5\n0 0\n255\n", b"P5\n1 0\n255\n", b"P2\n1 1\n255\n300", b"P5\n99999999 99999999\n255\nx", b"P5\n1 1\n0\nx", media.encode_bmp(np.zeros((1, 1), np.uint8))[:22] + bytes(4) + bytes(30)]
    deep = b"P5\n1 1\n65535\n" + (40000).to_bytes(2, "big")
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([*bad, deep])], "i int, media binary")
    got = {r.i: r.tile for r in media.decode_media(df).selectExpr("i", "decoded.tile as tile").collect()}
    assert [got[i] for i in range(len(bad))] == [None] * len(bad)
    assert np.load(io.BytesIO(got[len(bad)])).tolist() == [[40000] * 16] * 16


def test_tiles_are_written(spark, frame, tmp_path):
    media.write_tiles(media.text_media(frame(["abc", None])), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sorted(r.doc_id for r in back) == [0, 1] and all(np.load(io.BytesIO(r.tile)).shape == (16, 16) for r in back)


def test_media_of_nothing(frame):
    assert media.text_media(frame(ODD).where("doc_id < 0")).count() == 0


def words_of(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(doc_words, items, run=13):
    """Hit words and items by comparing every window."""
    hit, found = set(), set()
    for item, own in items.items():
        size = min(run, len(own))
        for s in range(len(own) - size + 1 if size else 0):
            for i in range(len(doc_words) - size + 1):
                if doc_words[i : i + size] == own[s : s + size]:
                    hit.update(range(i, i + size))
                    found.add(item)
    return len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 2])
def test_decontamination_gives_a_row_for_each_row(spark, frame, words, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_PHRASES", block)
    b = spark.createDataFrame([(i, " ".join(words(15, i))) for i in range(3)], "item_id long, text string")
    rows = [(1, " ".join(words(15, 2))), (1, "clean text"), (2, None), (2, None), (None, "other"), (None, " ".join(words(15, 0)))]
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in dc.judge(dc.contaminated_spans(frame(rows), b)).collect())
    assert got == [(0, 1, 0), (0, 15, 15), (1, 2, 0), (1, 15, 15), (2, 0, 0), (2, 0, 0)]
    kept = dc.drop_contaminated(frame(rows).selectExpr("*", "1L as row"), b)
    assert sorted((r.doc_id or 0, r.text or "", r.row) for r in kept.collect()) == [(0, "other", 1), (1, "clean text", 1), (2, "", 1), (2, "", 1)]


def test_decontamination_matches_brute_force(spark, frame, words, monkeypatch):
    items = {"7": " ".join(words(30, 1)), "10": "Short item", "x": None, "y": " , ", "z": " ".join(words(13, 2)), "d": " ".join(words(30, 1))}
    long, z = items["7"].split(), items["z"]
    texts = [None, "", "nothing", f"a {z.upper()} b {z}", " ".join(long[:12]), " ".join(long[:14]) + " tail " * 400, "a short-item here", " ".join(long) * 2, z + " " + z]
    b = spark.createDataFrame(list(items.items()), "item_id string, text string")
    expected = {}
    wanted = {k: words_of(v) for k, v in items.items()}
    for i, t in enumerate(texts):
        w = words_of(t)
        n, found = brute_hits(w, wanted)
        expected[i] = (len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
    for block in (200_000, 2):  # at once, and phrase block by phrase block
        monkeypatch.setattr(dc, "BLOCK_PHRASES", block)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.judge(dc.contaminated_spans(frame(texts), b)).collect()}
        assert got == expected
    assert sorted(r.doc_id for r in dc.drop_contaminated(frame(texts), b).collect()) == [i for i in expected if not expected[i][4]]
    assert dc.judge(dc.contaminated_spans(frame(texts), b.where("item_id = 'none'"))).where("n_hit > 0").count() == 0


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = dc.FMIndex(text, 4)
    for size in (1, 3, 8):
        p = text[50 : 50 + size][None]
        low, high = index.search(p, np.array([size]))
        places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert places == [i for i in range(301 - size) if (text[i : i + size] == p[0]).all()]


def test_chat_parsing():
    t = "System: be brief\nUser: hi there\nmore?\nsure, fine\nAI: ok\nQ: next?\nA: yes"
    assert [r for r, _ in chat.parse(t)] == ["system", "user", "assistant", "user", "assistant"]
    assert chat.parse(t)[1][1] == "hi there\nmore?\nsure, fine"
    assert chat.parse(None) == chat.parse(" \n") == [] and chat.render([]) == ""


def test_chat_over_conversations(spark, small):
    from lodestone.llm.registry import QUERIES

    out = QUERIES["op8_chat"](spark, small).toPandas()
    assert out.roles_match.mean() > 0.85
    odd = spark.createDataFrame([(1, None, None, None), (1, 1, "user", "x"), (1, 1, "user", "x"), (None, 5, "assistant", "")], "conv_id long, turn long, role string, text string")
    assert chat.format_transcripts(chat.transcripts(odd)).count() == 2
    many = spark.range(600).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "'t' as text")
    assert sorted(r.part for r in chat.transcripts(many).collect()) == [0, 1, 2]


def test_chat_blocks_give_the_states_of_the_whole(spark, monkeypatch):
    r = random.Random(5)
    texts = ["what is it?", "and so on", "Fine.", "", "a\nb?\n", "Yes\n\nno", "t"]
    roles = ["user", "assistant"]
    turns = [(7, r.choice([i, i, i // 9, None]), r.choice(["system", *roles * 4]), r.choice(texts)) for i in range(300)]
    turns += [(8, i, roles[i % 2], "what is it?" if i % 2 else "Tell me") for i in range(120)]
    turns += [(None, i, "user", "t") for i in range(40)] + [(9, 0, "user", "x"), (10, None, None, None), *[(11, 1, "assistant", "same")] * 50]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = {x.conv_id: x for x in chat.transcripts(frame).collect() if x.part == 0}
    assert len(whole) == 6 and not [x for x in chat.transcripts(frame).collect() if x.conv_id == 8 and x.part]
    monkeypatch.setattr(chat, "PART_TURNS", 16)
    blocks = chat.transcripts(frame).collect()
    assert max(len(x.true_roles.split(",")) for x in blocks) == 16
    chats = chat.rendered(frame).collect()
    assert len(chats) == 6
    for x in chats:
        own = sorted((b.part, b.transcript, b.true_roles) for b in blocks if b.conv_id == x.conv_id)
        text = "\n".join(t for _, t, _ in own)
        found = chat.parse(text)
        out = chat.render(found)
        assert (x.n_turns, x.roles, x.rendered_chars) == (len(found), ",".join(y for y, _ in found), len(out))
        assert x.rendered_sha256 == hashlib.sha256(out.encode()).hexdigest() and x.true_roles == ",".join(y for _, _, y in own)


def test_pipeline_on_small_tables(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, small)
        assert set(out.columns) == set(docs.columns)
    assert 0 < out.count() < docs.count()
    assert corpus_pipeline.run(spark, small).count() > 0


def test_transcripts_with_clashing_columns(spark):
    df = spark.createDataFrame([("User: hi\nAssistant: hello", 1, "x")], "transcript string, turns int, rendered string")
    got = chat.format_transcripts(df)
    assert got.columns == ["transcript", "turns", "rendered"] and [t.role for t in got.first().turns] == ["user", "assistant"]


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(7)
    lines = ["User: hi there?", "", "lower case", "Assistant: Yes", "System: be kind", "A: ok?", "text"]
    for _ in range(12):
        own = [lines[i] for i in rng.integers(0, len(lines), 5)]
        emit, _ = chat.observe(own)
        total = lambda p, emit=emit: chat.START[p[0]] + sum(emit[i, s] for i, s in enumerate(p)) + sum(chat.STEP[a, b] for a, b in itertools.pairwise(p))
        best = max(total(p) for p in itertools.product(range(len(chat.STATES)), repeat=5))
        assert total(chat.viterbi(emit)) == best


def test_difference_hash_against_loops():
    from fractions import Fraction

    def mean(image, top, bottom, left, right):
        out = Fraction(0)
        for y in range(image.shape[0]):
            for x in range(image.shape[1]):
                h, w = min(bottom, y + 1) - max(top, y), min(right, x + 1) - max(left, x)
                if h > 0 and w > 0:
                    out += h * w * int(image[y, x])
        return out / ((bottom - top) * (right - left))

    rng = np.random.default_rng(8)
    for shape in ((1, 64), (3, 64), (8, 9), (13, 20)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        h, w = Fraction(shape[0], 8), Fraction(shape[1], 9)
        small = [[mean(image, i * h, (i + 1) * h, j * w, (j + 1) * w) for j in range(9)] for i in range(8)]
        assert np.allclose(media.area_resize(image, 8, 9), np.array(small, float))
        bits = [small[i][j + 1] > small[i][j] for i in range(8) for j in range(8)]
        got = np.unpackbits(np.frombuffer(bytes.fromhex(media.difference_hash(image)), np.uint8))
        clear = [abs(small[i][j + 1] - small[i][j]) > Fraction(1, 100) for i in range(8) for j in range(8)]
        assert [b for b, c in zip(got.tolist(), clear, strict=True) if c] == [int(b) for b, c in zip(bits, clear, strict=True) if c]


def test_network_scores_against_loops():
    from lodestone.llm import language

    rng = np.random.default_rng(9)
    x = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    p = {f"w{w}": rng.normal(0, 0.3, (w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS}
    hidden = language.FILTERS * len(language.WIDTHS)
    p |= {"c": rng.normal(0, 0.3, hidden).astype(np.float32), "v": rng.normal(0, 0.3, (hidden, 3)).astype(np.float32), "b": rng.normal(0, 0.3, 3).astype(np.float32)}
    expected = []
    for row in x:
        pooled = [max(sum(float(p[f"w{w}"][j, row[i + j], f]) for j in range(w)) for i in range(language.WINDOW - w + 1)) for w in language.WIDTHS for f in range(language.FILTERS)]
        z = np.maximum(np.array(pooled) + p["c"], 0) @ p["v"] + p["b"]
        expected.append(z - np.log(np.exp(z).sum()))
    assert np.allclose(language.Network(p).log_probs(x), expected, atol=1e-4)
