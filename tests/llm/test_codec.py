"""BPE, packing, GIF and sharding: exact against the libraries, round trips, edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from trialgrid.llm import bpe, gif, packing, sharding  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "  a  b ", "a<|endoftext|> b <|endoftext|>", " x", "x ", "\n\n a\t b \r\n", "日本語 テキスト ΣΑΣ İx", "don't 12 34   56 !!??", "🎉🎉 é   x 　", "\x1c a\x1cb", "aaaa" * 50, "    " * 30 + "x"]


def noise(n, letters="abcdefghijklmnopqrstuvwxyz '.,!0123\n éüß"):
    r = random.Random(4)
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_bpe_is_the_librarys():
    lib, own = Tokenizer.from_file(BYTES), bpe.Encoder(BYTES, table=50)
    for t in TEXTS + noise(2000):
        ids = own.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_rows(odd_docs, no_docs):
    lib = Tokenizer.from_file(BYTES)
    got = bpe.encode_documents(odd_docs, BYTES, digest_only=True).collect()
    want = sorted((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for r in odd_docs.collect() for ids in [lib.encode(r["text"] or "", add_special_tokens=False).ids])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in got) == want
    assert bpe.encode_documents(no_docs, BYTES).count() == 0
    whole = {r["doc_id"]: r for r in bpe.encode_documents(odd_docs, BYTES).collect()}
    assert whole[10]["decoded"] == "ÉÈ ß 日本語 🎉 \x1c <|endoftext|> don't" and whole[1]["ids"] == []


def test_word_encoder_is_the_librarys():
    lib, own = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS, table=50)
    texts = TEXTS + noise(2000, "abcdefgh XYZ'é̀Ü.,!01\n") + ["a<|startoftext|>B"]
    for t, ids in zip(texts, own.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_plan_covers_the_histogram_and_packs_well():
    r = random.Random(5)
    lengths = Counter(min(2048, int(r.lognormvariate(5.5, 1))) or 1 for _ in range(20_000))
    plan = packing.plan_bins(lengths)
    used = Counter()
    for bin_, times in plan:
        assert sum(bin_) <= 2048 and times > 0
        for n in bin_:
            used[n] += times
    assert used == lengths
    least = -(-sum(n * c for n, c in lengths.items()) // 2048)
    assert sum(t for _, t in plan) <= 1.01 * least + 1
    # greedy fills 6 + 3; taking out the 3 makes room for 2 + 2, which fits 10 exactly
    assert [6, 2, 2] in [b for b, _ in packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)]


def test_packing_rows(odd_docs, no_docs):
    lib = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(odd_docs, WORDS, with_ids=True).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["piece"], r["start"]), []).append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == 2048 or r["piece"] == max(x["piece"] for x in got if x["doc_id"] == r["doc_id"])
    for d in odd_docs.collect():
        ids = [*lib.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        pieces = [i for k in range(0, len(ids), 2048) for i in by_doc[d["doc_id"], k // 2048, k][0]["ids"]]
        assert pieces == ids
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def plain_lzw(pixels):
    """A greedy encoder, code by code."""
    table, new, width, acc, bits, out = {}, 258, 9, 256, 9, bytearray()

    def emit(code, width):
        nonlocal acc, bits
        acc |= code << bits
        bits += width
        while bits >= 8:
            out.append(acc & 255)
            acc >>= 8
            bits -= 8

    before = pixels[0]
    for b in pixels[1:]:
        key = before << 8 | b
        if key in table:
            before = table[key]
            continue
        emit(before, width)
        if new < 4096:
            table[key] = new
            if new == 1 << width and width < 12:
                width += 1
            new += 1
        else:
            emit(256, width)
            table, new, width = {}, 258, 9
        before = b
    emit(before, width)
    if new < 4096 and new == 1 << width and width < 12:
        width += 1
    emit(257, width)
    out.append(acc & 255)
    return bytes(out)


@pytest.mark.parametrize("pixels", [b"a", b"ab" * 2000, b"a" * 40_000, bytes(range(256)) * 200, bytes(random.Random(1).randrange(256) for _ in range(20_000)), ("the cat sat on the mat " * 900).encode()])
def test_lzw_round_trips(pixels):
    assert gif.lzw_decode(plain_lzw(pixels), 8, len(pixels)).tobytes() == pixels
    assert gif.lzw_decode(gif.lzw_encode(pixels), 8, len(pixels)).tobytes() == pixels


def test_gif_composition_by_hand():
    import struct

    def frame(pixels, left, top, w, h, disposal, transparent=None, local=b""):
        flags = disposal << 2 | (transparent is not None)
        control = b"\x21\xf9\x04" + struct.pack("<BHBB", flags, 7, transparent or 0, 0)
        return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x80 if local else 0) + local + b"\x08" + gif._blocks(gif.lzw_encode(bytes(pixels)))

    palette = bytes(v for i in range(256) for v in (i, i, i))
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0xF7, 0, 0) + palette
    data = head + frame([10, 20, 30, 40], 0, 0, 2, 2, 1) + frame([99, 5], 0, 0, 2, 1, 2, 5) + frame([7], 1, 1, 1, 1, 3) + frame([0], 0, 1, 1, 1, 0, None, b"\xff\x00\x00" * 2) + b"\x3b"
    shown = [(f.delay_ms, f.canvas.copy()) for f in gif.read_gif(data)]
    red = [f.canvas[:, :, 0].tolist() for f in gif.read_gif(data)]
    assert [d for d, _ in shown] == [70] * 4
    assert red[0] == [[10, 20], [30, 40]]
    frames = list(f.canvas.copy()[:, :, 0].tolist() for f in gif.read_gif(data))
    assert frames[1] == [[99, 20], [30, 40]]  # transparent pixel keeps what is below
    assert frames[2] == [[0, 0], [30, 7]]  # the second frame's area was cleared
    assert frames[3] == [[0, 0], [255, 40]]  # the third frame was taken back, a palette of its own
    assert list(gif.read_gif(b"no gif")) == [] and list(gif.read_gif(b"")) == []


def test_gif_rows(odd_docs, no_docs):
    got = gif.media_digests(odd_docs).collect()
    want = {}
    for r in odd_docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.setdefault(str(r["doc_id"]), (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[str(r["doc_id"])]
        assert sum(map(int, r["feature"].split(","))) == r["payload_bytes"]
    assert len(got) == odd_docs.count() and gif.media_digests(no_docs).count() == 0
    frames = gif.gif_frames(gif.text_gifs(odd_docs.where("doc_id = 5")), "doc_id", "gif").orderBy("frame").collect()
    text = odd_docs.where("doc_id = 5").collect()[0]["text"].encode()
    assert b"".join(f["indices"] for f in frames).rstrip(b" ") == text.rstrip(b" ") and len(frames) > 3


def test_shards(spark, odd_docs, no_docs):
    top = sharding.build_topology(40)
    df = spark.range(20_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    got = sharding.assign_shards(df, top).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) < 1.3 * 500 and min(sizes.values()) > 0.7 * 500
    assert 0.5 < Counter(r["grown_shard"] for r in got)[40] / (20_000 / 41) < 1.5
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    odd = sharding.assign_shards(odd_docs, top).collect()
    assert len(odd) == 14 and {r["size"] for r in odd if r["doc_id"] == 1} == {16} and len({r["shard"] for r in odd if r["doc_id"] == 6}) == 1
    assert sharding.assign_shards(no_docs, top).count() == 0


def test_a_changed_weight_moves_rows_only_through_its_subtree(spark):
    top = sharding.build_topology(20)
    df = spark.range(5000).selectExpr("cast(id AS string) AS k")
    rows = df.select(sharding.tree_shard(df["k"], top).alias("a"), sharding.tree_shard(df["k"], sharding.reweigh(top, 3, 2.0)).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(b < 10 for _, b in moved)  # into the region whose weight grew
    assert all(b < 5 for a, b in moved if a < 10) and all(b == 3 for a, b in moved if a < 5)


def test_gif_reader_takes_what_is_broken():
    import struct

    head = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0, 0, 0)
    frame = b"\x2c" + struct.pack("<HHHHB", 0, 0, 4, 4, 0x80)
    for data in (head + frame, head + frame + b"\1\2\3\4\5\6", head + frame + b"\1" * 6 + b"\x0c\2\0\0\0"):
        assert list(gif.read_gif(data)) == []


def test_shards_of_text_ids(spark):
    rows = [(f"id-{i}", "x" * i) for i in range(50)] + [("7", None), (None, "y"), ("id-1", "x")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id string, text string"), sharding.build_topology(4)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 53 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_lzw_streams_that_grow_without_end(monkeypatch):
    """Codes that each add a byte to one string, then repeats of the longest: valid, and gigabytes if all of it were made."""
    codes = np.concatenate((np.zeros(1, np.int64), 258 + np.arange(3800), np.full(600_000, 258 + 3799)))
    packed = gif._packed(codes)
    got = gif.lzw_decode(packed, 8, 49_152)
    assert len(got) == 49_152 and not got.any()
    some = np.concatenate((np.arange(200), 258 + np.arange(150)))
    full = gif.lzw_decode(gif._packed(some), 8, 500)
    for want in (1, 199, 200, 201, 350, 499):  # any cut gives the same bytes up to it
        assert (gif.lzw_decode(gif._packed(some), 8, want) == full[:want]).all()


def test_frames_too_large_have_a_row_that_says_so(monkeypatch, spark):
    small = [gif.write_gif(bytes(range(192)) * 2), gif.write_gif(b"a" * 192)]
    # a frame of 192 x 2 is too large, its file's later frames are read nevertheless
    monkeypatch.setattr(gif, "MAX_PIXELS", 383)
    body = small[0][:-1] + small[1][13 + 768 :]
    frames = list(gif.read_gif(body))
    assert [(f.number, f.width, f.height, f.problem is not None, f.indices is None, f.canvas is None) for f in frames] == [(0, 192, 2, True, True, True), (1, 192, 1, True, False, True)]
    assert frames[1].indices.tobytes() == b"a" * 192
    monkeypatch.undo()
    df = spark.createDataFrame([(1, bytearray(small[1])), (2, None), (3, bytearray(b"no"))], "k long, g binary")
    rows = gif.gif_frames(df, "k", "g").collect()
    assert [(r["k"], r["width"], r["height"], r["problem"], bytes(r["indices"])) for r in rows] == [(1, 192, 1, None, b"a" * 192)]
