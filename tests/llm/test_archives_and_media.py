from __future__ import annotations

import base64
import hashlib
import os
import random
import zlib

import pytest
import zstandard

from lekhya.llm import matroska as M
from lekhya.llm import common, queries, warc
from lekhya.llm.common import keep


def test_archives_give_back_every_record(spark):
    rng = random.Random(1)
    html = ["<p>" + "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 900))) + "é</p>" for _ in range(50)]
    rows = [(i, f"http://h/{i}", html[i % 40]) for i in range(90)] + [(200, None, None), (201, "http://x/\r\n", ""), (7, "http://h/7", html[7]), (None, "u", html[3]), (202, "http://big/", html[0] * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as first", "3 as s")
    table = keep(warc.archives(pages), "archives")
    got = warc.records(table).collect()
    assert len(got) == len(rows)
    want = {}
    for i, _, h in rows:
        if i is not None:
            want[h or ""] = min(i, want.get(h or "", i))
    text = {i: h or "" for i, _, h in rows}
    for r in got:
        body = text[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        first = want[text[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.payload is None or bytes(r.payload) == body
    for data, places in table.collect():
        records = list(warc.read_archive(bytes(data)))
        assert int.from_bytes(bytes(data)[:4], "little") == warc.DICTIONARY_FRAME and len(records) == len(places)
        for (_, block), place in zip(records, places, strict=True):
            assert warc.read_record(bytes(data), place).endswith(block + b"\r\n\r\n")
    assert warc.records(warc.archives(pages.limit(0))).count() == 0
    few = warc.planned(pages, 1).where("html = ''").collect()
    assert all(r.refers_to is None for r in few)  # payloads under the least size are all responses


@pytest.mark.parametrize("most", [0, 1, 1_000_000])
def test_a_frequent_payload_is_planned_alike(spark, monkeypatch, most):
    """A third of all pages share a payload, others are pairs or alone: broadcast, by shuffle, or hot ones of many broadcast alone."""
    rows = [(i, f"u{i}", "error page" if i % 3 == 0 else f"pair {i // 4}" if i % 3 == 1 else f"own {i}") for i in range(3000)]
    for module in (warc, common):
        monkeypatch.setattr(module, "BROADCAST_KEYS", most)
    got = {r.page_id: r.refers_to for r in warc.planned(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert got == {i: None if first[h] == i else first[h] for i, _, h in rows}


def test_the_dictionary_pays():
    rng = random.Random(3)
    common = "".join(rng.choice("abcdefgh <>/") for _ in range(3000))
    records = [warc.record("response", f"urn:page:{i}", "u", (common[rng.randint(0, 2000) :][:900] + str(i)).encode(), "1970-01-01T00:00:00Z") for i in range(400)]
    plain = sum(len(zstandard.ZstdCompressor().compress(r)) for r in records)
    assert len(warc.write_archive(records)[0]) < 0.6 * plain


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 8, 576 * 8 * 7, 40_000, 300_001])
def test_round_trip(n):
    payload = M.padded(os.urandom(n))
    data = M.mux(payload)
    media = M.demux(data)
    assert len(payload) % 576 == 0 and payload and M.track_bytes(data, media) == payload
    assert media.duration == len(payload) and [c for _, _, c in media.cues] == media.clusters
    assert [p[1] for p in media.packets] == list(range(0, len(payload), 576)) and media.tracks[1]["codec"] == "A_PCM/INT/LIT"


def test_lacing_sizes_and_damage():
    rng = random.Random(2)
    for kind in (M.XIPH, M.EBML_LACE, M.FIXED):
        for _ in range(50):
            frames = [os.urandom(600 if kind == M.FIXED else rng.choice([0, 1, 62, 63, 64, 254, 255, 256, 600, 20_000])) for _ in range(rng.randint(1, 9))]
            data = M.lace(frames, kind)
            assert [data[a:b] for a, b in M.unlace(data, 0, len(data), kind)] == frames
    for x in (0, 126, 127, 128, 16_382, 16_383, 1 << 40):
        assert M.read_vint(M.vint(x), 0) == (x, len(M.vint(x)))
    assert M.read_vint(b"\xff", 0)[0] == -1
    data = M.mux(M.padded(b"x" * 5000))
    for cut in (1, 30, 200, len(data) - 1):
        with pytest.raises((ValueError, IndexError)):
            M.demux(data[:cut])


def test_media_contract(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = M.digests(odd_docs).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * ((-len(raw)) % 576 or 576 * (not raw))
        want.append((i is None, i or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert len({r.media_sha256 for r in got}) == len({r.payload_sha256 for r in got})
    assert M.digests(no_docs).count() == 0
    packets = M.packet_table(M.store(odd_docs.where("doc_id = 107"))).collect()
    assert len(packets) == next(r.payload_bytes for r in got if r.doc_id == 107) // 576
    broken = M.packet_table(spark.createDataFrame([(1, b"not a file"), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.track) for r in broken] == [(1, None)] and "Error" in broken[0].error  # an empty file has no packet


def test_queries_are_all_there():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def layout(track, blocks, cues=b"", scale=1_000_000):
    """A file with the given track elements, cluster elements and cue elements, of sizes unknown in advance where the format allows it."""
    info = M._element(M.INFO, M._uint(M.TIMESTAMP_SCALE, scale))
    tracks = M._element(M.TRACKS, b"".join(M._element(M.TRACK_ENTRY, t) for t in track))
    unknown = b"\x01" + b"\xff" * 7
    cluster = M._id(M.CLUSTER) + unknown + M._uint(M.TIMESTAMP, 1000) + b"".join(blocks)
    return M._element(M.EBML, M._element(M.DOC_TYPE, b"webm")) + M._id(M.SEGMENT) + unknown + M._element(M.VOID, b"xx") + info + tracks + cluster + (M._element(M.CUES, cues) if cues else b"")


def test_timestamps_of_other_layouts():
    frames = [b"a" * 10, b"b" * 20, b"c" * 30]
    block = lambda n, offset, kind: M.vint(n) + bytes([offset >> 8, offset & 255, kind << 1 | 0x80]) + M.lace(frames, kind)
    opus = M._uint(M.TRACK_NUMBER, 1) + M._element(M.CODEC_ID, b"A_OPUS") + M._uint(M.DEFAULT_DURATION, 20_000_000)
    audio = M._element(M.SAMPLING, M.struct.pack(">f", 1000.0)) + M._uint(M.CHANNELS, 2) + M._uint(M.BIT_DEPTH, 16) + M._element(M.VOID, b"")
    pcm = M._uint(M.TRACK_NUMBER, 200) + M._element(M.CODEC_ID, b"A_PCM/INT/LIT") + M._element(M.AUDIO, audio)
    other = M._uint(M.TRACK_NUMBER, 3) + M._element(M.CODEC_ID, b"S_TEXT")
    group = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block(3, 50, M.EBML_LACE)) + M._uint(M.BLOCK_DURATION, 90) + M._uint(M.REFERENCE, 1))
    position = lambda t, at: M._element(M.CUE_POSITIONS, M._uint(M.CUE_TRACK, t) + M._uint(M.CUE_CLUSTER, at))
    cues = M._element(M.CUE_POINT, M._uint(M.CUE_TIME, 1000) + position(1, 40) + position(200, 41)) + M._element(M.VOID, b"-")
    data = layout([opus, pcm, other], [M._element(M.SIMPLE_BLOCK, block(1, 5, M.XIPH)), M._element(M.SIMPLE_BLOCK, block(200, 7, M.XIPH)), group], cues)
    media = M.demux(data)
    assert [(t, when, key) for t, when, key, _, _ in media.packets] == [
        (1, 1005, True), (1, 1025, True), (1, 1045, True),
        (200, 1007, True), (200, 1010, True), (200, 1014, True),  # 4 bytes a sample, one sample a millisecond: 2.5 and 5 ticks, rounded
        (3, 1050, False), (3, 1080, False), (3, 1110, False),
    ]
    assert [data[a:b] for *_, a, b in media.packets] == frames * 3
    assert media.cues == [(1000, 1, 40), (1000, 200, 41)] and media.doc_type == "webm"
