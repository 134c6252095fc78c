"""Token files, packing and media: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import matroska, media, packing, token_files
from weftline.llm.text import documents
from weftline.llm.tokens import Encoder, encoder

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a  b\n\n c", "don't 'S it's\ta", "x　y z", " \n \n x", "é ñ b  ", "<|endoftext|> x", "a\x1cb c", "A" * 300, "abc ́def", "İstanbul ΣΑΣ", "²³ x½", "l'été qu'il", "ǅ ⅷ", "हिन्दी भाषा", "ﬁne", "a\r\nb", "x ́", "a 's b",
       "can't've", "9 99  9", 'a"###', "x)**", "9\"!", "'s**", "a'**", "a.b. c,", "!?", "日本語 です", "\x00a \x07", "w " * 3000]


def reference(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_exact(spark, name):
    rng = random.Random(1)
    texts = ODD + [r["text"] for r in documents(spark, SF).limit(60).collect()]
    texts += ["".join(rng.choice("ab 'sZ.,#é9\n\t ") for _ in range(40)) for _ in range(400)]
    code = Encoder(public_tokenizers.path(name))
    for text, ids in zip(texts, reference(name)(texts), strict=True):
        assert np.frombuffer(code.ids(text), code.dtype).tolist() == ids, text


DIRTY = "doc_id long, text string, shard string, ids string, lane string"
ROWS = [(7, "some words here", "a", "b", "c"), (7, "some words here", "a", "b", "c"), (3, None, None, None, None), (None, "x", "a", None, None), (9, "", None, None, None), (1, "long " * 9000, None, None, None)]


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(spark.createDataFrame(ROWS, DIRTY), path, public_tokenizers.path("word_bpe_49k.json"))
    tokens = token_files.read_tokens(spark, path)
    found = token_files.digest_tokens(tokens).orderBy("start").collect()
    ids = reference("word_bpe_49k.json")([r[1] or "" for r in ROWS])
    at = 0
    for (doc_id, *_), mine in sorted(zip([(r[0], r[1]) for r in ROWS], ids, strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
        row = found.pop(0)
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, at, len(mine) + 1)
        assert row["ids_crc32"] == zlib.crc32(np.array([*mine, 2], "<u4").tobytes())
        at += len(mine) + 1
    assert token_files.lookup(spark, path, [9, 1]).count() == 2
    plan = token_files.lookup(spark, path, [9])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in plan or "EqualTo(doc_id,9)" in plan
    token_files.write_tokens(spark.createDataFrame([], DIRTY), path + "-empty", public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.digest_tokens(token_files.read_tokens(spark, path + "-empty")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plans_cover_every_remainder_once(seed):
    rng = np.random.default_rng(seed)
    window, n = [2048, 64, 16][seed % 3], [1, 7, 400, 20_000][seed % 4]
    lengths = np.minimum(window - 1, rng.exponential(window / 3, n).astype(int))
    if seed % 2:
        lengths[: n // 3] = window // 3
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    made = packing.plan(histogram, window, 5)
    sequences = {}
    for r, rows in made.pieces.items():
        cover = np.zeros((histogram[r], r), int)
        for lo, hi, start, length, sequence, offset in rows:
            cover[lo:hi, start : start + length] += 1
            for k in range(hi - lo):
                sequences.setdefault(sequence + k, []).append((offset, length))
        assert (cover == 1).all()
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0 and sorted(sequences) == list(range(5, made.sequences))


def test_least_squares():
    columns = [((3, 1), (5, 1)), ((4, 2),), ((1, 1), (7, 1))]
    target = np.array([0, 2, 0, 5, 6, 4, 0, 3])
    x = packing.nnls(columns, target, 200)
    assert (x >= 0).all() and np.allclose(x, [4.5, 3, 2.5], atol=1e-3)


def check_pieces(rows, texts, window=2048):
    ids = reference("byte_bpe_50k.json")([t or "" for _, t in texts])
    wanted, found, sequences = {}, {}, {}
    for (doc, _), x in zip(texts, ids, strict=True):
        wanted.setdefault(doc, []).append([*x, 1])
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(found) == set(wanted)
    for doc, copies in wanted.items():
        pieces = sorted(found[doc], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == sum(map(len, copies))
        for r in pieces:
            assert any(r["ids_crc32"] == zlib.crc32(np.array(c[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(c) for c in copies)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window


def test_packing_documents(spark):
    texts = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    check_pieces(packing.op4(spark, SF).collect(), texts)


def test_packing_dirty_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "LANE_ROWS", 2)
    rows = packing.packed_documents(spark.createDataFrame(ROWS, DIRTY)).collect()
    check_pieces(rows, [(r[0], r[1]) for r in ROWS])
    assert packing.packed_documents(spark.createDataFrame([], DIRTY)).count() == 0


def test_sequences_hold_the_ids(spark):
    pieces = packing.pack(spark.createDataFrame(ROWS, DIRTY), public_tokenizers.path("byte_bpe_50k.json"), window=64)
    made = packing.sequences(pieces)
    assert made.where("length > 64 OR length(ids) <> 2 * length").count() == 0
    assert made.agg({"length": "sum"}).first()[0] == pieces.agg({"length": "sum"}).first()[0]


# -- media -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [64, 512, 576, 1024, 4096, 4160, 131_072, 131_136, 300_032])
def test_matroska_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = matroska.mux_pcm8(payload)
    found = matroska.parse(data)
    assert matroska.read_pcm(data, found) == payload
    assert found.tracks[1].codec == "A_PCM/INT/LIT" and found.tracks[1].bits == 8 and found.tracks[1].rate == 8000
    assert len(found.packets) == -(-n // 512) and [p[1] for p in found.packets] == [i * 64_000_000 for i in range(len(found.packets))]
    assert len(found.cues) == -(-n // 131_072)
    for time, track, at in found.cues:
        assert data[at : at + 4] == matroska.CLUSTER.to_bytes(4, "big") and track == 1
        assert min(p[1] for p in found.packets if p[2] > at) == time


def hand_made(lacing, table, frames, size=None, group=False):
    flags = lacing << 1 | (0 if group else 0x80)
    block = b"\x81\x00\x05" + bytes([flags]) + table + b"".join(frames)
    inner = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block) + matroska.number(matroska.REFERENCE_BLOCK, 1)) if group else matroska.element(matroska.SIMPLE_BLOCK, block)
    body = matroska.number(matroska.CLUSTER_TIMESTAMP, 100) + inner
    cluster = matroska.CLUSTER.to_bytes(4, "big") + (b"\x01" + b"\xff" * 7 if size == "unknown" else matroska.size_vint(len(body))) + body
    return matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + matroska.element(matroska.CUES, b"")


@pytest.mark.parametrize(
    "lacing, table, sizes",
    [(0, b"", [9]), (1, bytes([2, 255, 45, 7]), [300, 7, 20]), (2, bytes([3]), [5, 5, 5, 5]), (3, bytes([2]) + b"\x43\x20" + b"\x5e\xd3", [800, 500, 1000])],
)
@pytest.mark.parametrize("size", [None, "unknown"])
@pytest.mark.parametrize("group", [False, True])
def test_lacing(lacing, table, sizes, size, group):
    frames = [bytes([65 + i]) * n for i, n in enumerate(sizes)]
    data = hand_made(lacing, table, frames, size, group)
    found = matroska.parse(data)
    assert [data[p[2] : p[2] + p[3]] for p in found.packets] == frames
    assert {p[1] for p in found.packets} == {105_000_000} and {p[4] for p in found.packets} == {not group}


def test_broken_media_raise_value_errors():
    good = matroska.mux_pcm8(random.Random(1).randbytes(5000))
    rng = random.Random(2)
    for _ in range(500):
        bad = bytearray(good[: rng.randint(1, len(good))])
        for _ in range(rng.randint(0, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            matroska.parse(bytes(bad))
        except ValueError:
            pass


def test_media_tables(spark):
    rows = [(1, "some text " * 200), (2, None), (3, ""), (3, ""), (None, "x")]
    stored = media.stored(spark.createDataFrame(rows, "doc_id long, text string"))
    packets = media.packets(stored)
    assert packets.where("doc_id = 1").count() == 4 and packets.where("error IS NOT NULL").count() == 0
    assert media.cues(stored).count() == 5
    broken = spark.createDataFrame([(1, bytearray(b"\x1aE\xdf\xa3\x84ab")), (2, None)], "doc_id long, media binary")
    assert [r["doc_id"] for r in media.packets(broken).collect() if r["error"]] == [1] and media.cues(broken).count() == 0
    assert media.features(broken.selectExpr("*", "1L AS n_bytes")).where("feature IS NULL").count() == 2
    clash = spark.createDataFrame([(1, "t", "p", "q", 5, "e")], "doc_id long, text string, packets string, cues string, n_bytes int, error string")
    assert media.features(media.stored(clash)).first()["n_bytes"] == 1 and media.features(media.stored(clash.limit(0))).count() == 0
    found = media.features(stored).collect()
    assert len({tuple(r)[1:] for r in found if r["doc_id"] in (2, 3)}) == 1


def test_media_query(spark):
    plan = media.op5(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "media" in plan[plan.index("Scan parquet") :] and plan.count("MapInArrow") == 2 and "Exchange" not in plan
    for r, d in zip(media.op5(spark, SF).orderBy("doc_id").collect(), documents(spark, SF).orderBy("doc_id").collect(), strict=True):
        raw = (d["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = matroska.mux_pcm8(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


# -- added tokens ----------------------------------------------------------------------------

SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n", "<|startoftext|>Some Words<|endoftext|><|endoftext|> é's", "a <|ENDOFTEXT|> b", "<|endoftext", "<| endoftext |>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_the_librarys(name):
    """The encoder of the queries against a tokenizer as it comes."""
    plain, code = Tokenizer.from_file(public_tokenizers.path(name)), encoder(public_tokenizers.path(name))
    for text in SPECIAL + ODD:
        assert np.frombuffer(code.ids(text), code.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_librarys_on_odd_letters(name):
    """Defaults of the library, over letters whose lower case or composition is odd, and added tokens."""
    plain, code = Tokenizer.from_file(public_tokenizers.path(name)), encoder(public_tokenizers.path(name))
    rng = random.Random(5)
    alphabet = ["İ", "ς", "Σ", "\u0307", "\u00ad", "ǅ", "ẞ", "ŉ", "ﬁ", "e\u0301", "K", "Å", "٣", "²", "Ⅷ", "一", "ा", "\u200d", "\u00a0", "\u3000", "a", "B", "s", "'", "9", " ", "  ", "\n", *",.;:!?*$%&#|)<>=-_", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) for _ in range(30_000)]
    for text, wanted in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(code.ids(text), code.dtype).tolist() == wanted.ids, text


def test_token_query(spark):
    """The registered query against the library as it comes, whole tables and texts."""
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, at = sorted((r["doc_id"], r["text"] or "") for r in documents(spark, SF).collect()), 0
    found = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in token_files.op3(spark, SF).collect())
    for row, (doc_id, _), e in zip(found, docs, plain.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        assert row == (doc_id, at, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes()))
        at += len(e.ids) + 1


def test_added_tokens_in_token_files_and_packing(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    plain = lambda name: [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(SPECIAL, add_special_tokens=False)]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, path, public_tokenizers.path("word_bpe_49k.json"))
    found = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.digest_tokens(token_files.read_tokens(spark, path)).collect()}
    assert found == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(plain("word_bpe_49k.json"))}
    lengths = {r["doc_id"]: r["doc_tokens"] for r in packing.packed_documents(df).collect()}
    assert lengths == {i: len(x) + 1 for i, x in enumerate(plain("byte_bpe_50k.json"))}


def test_equal_rows_are_spread(spark):
    """A third of the rows have no id and no text: no lane and no file holds many of them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, None) if i % 3 == 0 else (i, f"text {i} of a few words") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = packing.encoded(docs, path)
    hot = found.where("doc_id IS NULL").count()
    lanes = found.where("doc_id IS NULL").groupBy(packing.F.pmod(packing.F.xxhash64("doc_id", packing.F.crc32("ids"), "nth"), packing.F.lit(-(-hot // packing.LANE_ROWS)))).count()
    sizes = [r["count"] for r in lanes.collect()]
    assert sum(sizes) == 3000 and max(sizes) < 3 * packing.LANE_ROWS
    check_pieces(packing.packed_documents(docs).collect(), rows)
    token_files.write_tokens(docs, out := f"{spark.conf.get('spark.checkpoint.dir')}/spread-tokens", public_tokenizers.path("word_bpe_49k.json"), shards=6)
    files = [r["count"] for r in token_files.read_tokens(spark, out).groupBy("shard").count().collect()]
    assert len(files) == 6 and max(files) < 2 * 9000 / 6
