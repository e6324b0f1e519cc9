from __future__ import annotations

import http.server
import io
import json
import math
import struct
import threading
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lekhya.functions import text
from lekhya.operators import order, segments
from lekhya.sources import audio, readers, writers


def waved(levels, width, rate=16_000, channels=1):
    """A file by Python's own module: levels are whole numbers, little endian bytes of width."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"".join((x + 128).to_bytes(1, "little") if width == 1 else x.to_bytes(width, "little", signed=True) for x in levels))
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_whole_numbers_of_every_width(width):
    top = 1 << 8 * width - 1
    levels = [0, 1, -1, top - 1, -top, top // 3]
    x, rate, channels = audio.decode(waved(levels, width, 8000))
    assert (rate, channels) == (8000, 1) and np.allclose(x, [v / top for v in levels], atol=1e-7)


def test_other_forms():
    left_right = waved([1000, 3000, -500, 500], 2, channels=2)
    assert np.allclose(audio.decode(left_right)[0] * 32768, [2000, 0])
    values = np.array([0.5, -0.25, 1.0], "<f4").tobytes()
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 16_000, 64_000, 4, 32) + b"note" + struct.pack("<I", 3) + b"odd\0" + b"data" + struct.pack("<I", 12) + values
    assert audio.decode(b"RIFF" + struct.pack("<I", len(body)) + body)[0].tolist() == [0.5, -0.25, 1.0]
    wide = struct.pack("<IHHIIHHHHI", 40, 0xFFFE, 1, 16_000, 32_000, 2, 16, 22, 16, 4) + struct.pack("<H", 1) + bytes(14)
    body = b"WAVEfmt " + wide + b"data" + struct.pack("<Ihh", 4, 16384, -16384)
    assert audio.decode(b"RIFF" + struct.pack("<I", len(body)) + body)[0].tolist() == [0.5, -0.5]


def test_python_reads_what_is_written():
    x = np.array([0, 0.5, -0.5, 1, -1, 2, -7, math.nan], np.float32)
    with wave.open(io.BytesIO(audio.encode(x, 16_000)), "rb") as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, 2, 16_000, 8)
        assert np.frombuffer(w.readframes(8), "<i2").tolist() == [0, 16384, -16384, 32767, -32767, 32767, -32767, 0]


def test_damage_is_told(spark):
    good = waved([1, 2, 3], 2)
    bad = {1: b"", 2: b"RIFF", 3: good[:-1], 4: good[:40], 5: good[:12] + good[36:], 6: good[:36], 7: good.replace(b"\x01\x00\x01\x00", b"\x07\x00\x01\x00", 1), 8: waved([1], 2, 8000), 9: None}
    got = {r.recording_id: r for r in audio.decoded(spark.createDataFrame([(0, good), *bad.items()], "recording_id int, content binary"), ["recording_id"]).collect()}
    assert got[0].error is None and len(got[0].samples) == 3
    assert all(got[i].samples is None and got[i].error for i in range(1, 9)) and "rate of 8000" in got[8].error and got[9].samples is None


def test_from_files_to_segments_and_back(spark, tmp_path):
    """Audio and transcripts of files, through the filters, to segment files and a manifest."""
    t = np.arange(16_000 * 6) / 16_000
    tone = np.round(8000 * np.sin(2 * np.pi * 200 * t)).astype(int).tolist()
    for rid, content in ((1, waved(tone, 2)), (2, b"RIFFxxxx"), (3, waved(tone, 2))):
        (tmp_path / f"{rid}_audio.wav").write_bytes(content)
    said = [{"start": 0.5, "end": 3.0, "text": "one two  three four"}, {"start": 3.0, "end": 3.2, "text": "too short"}, {"start": 4, "end": 9, "text": "cut off at the end of the recording", "speaker_id": 4}]
    for rid in (1, 2):
        (tmp_path / f"{rid}_transcription.json").write_text(json.dumps(said))
    sounds = readers.recordings(spark, str(tmp_path))
    assert {r.recording_id: r.error is None for r in sounds.collect()} == {1: True, 2: False, 3: True}
    built = segments.build(sounds.where("error is null"), readers.transcripts(spark, f"{tmp_path}/*.json"), "latin")
    assert sorted((r.recording_id, r.segment_idx, r.skip_reason, r.duration) for r in built.collect()) == [(1, 0, None, 2.5), (1, 1, "too_short", 0.2), (1, 2, None, 2.0)]
    writers.segment_audio(built, str(tmp_path / "out"))
    back = {r.audio_path: r for r in readers.segment_audio(spark, str(tmp_path / "out")).collect()}
    assert set(back) == {"segments/1_0000.wav", "segments/1_0002.wav"} and all(r.error is None for r in back.values())
    first = back["segments/1_0000.wav"].samples
    assert len(first) == 40_000 and np.allclose(first, np.array(tone[8000:48_000]) / 32768, atol=1 / 16_000)
    writers.manifest(writers.manifest_rows(built), str(tmp_path / "manifest"))
    assert [(r.audio_path, r.text, r.speaker_id) for r in readers.manifest(spark, str(tmp_path / "manifest")).orderBy("segment_idx").collect()] == [("segments/1_0000.wav", "one two three four", None), ("segments/1_0002.wav", "cut off at the end of the recording", 4)]


def test_damaged_lines_are_errors_or_told(spark, tmp_path):
    good = json.dumps({"audio_path": "p", "text": "क", "recording_id": 1, "duration": 1.5, "segment_idx": 0}, ensure_ascii=False)
    (tmp_path / "m.json").write_text(f"{good}\n\n   \n{good[:-9]}\n{good}\n", encoding="utf-8")
    (tmp_path / "blank.json").write_text(f"\n{good}\n  \n", encoding="utf-8")
    assert readers.manifest(spark, str(tmp_path / "blank.json")).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.manifest(spark, str(tmp_path / "m.json")).collect()
    got = readers.manifest(spark, str(tmp_path / "m.json"), strict=False).collect()
    assert sorted(r.error is None for r in got) == [False, True, True] and [r.error for r in got if r.error] == [good[:-9]]
    (tmp_path / "5_transcription.json").write_text('[{"start": 1, "end": 2, "text": "a"}]')
    (tmp_path / "6_transcription.json").write_text('[{"start": 1, "end"')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.transcripts(spark, f"{tmp_path}/*_transcription.json").collect()
    loose = {r.recording_id: r for r in readers.transcripts(spark, f"{tmp_path}/*_transcription.json", strict=False).collect()}
    assert loose[5].error is None and loose[6].segments is None and '"end"' in loose[6].error
    damaged = tmp_path / "d.parquet"
    damaged.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        readers.dataset(spark, str(damaged), required=False)
    assert readers.dataset(spark, str(tmp_path / "none"), required=False) is None


class Flaky(http.server.BaseHTTPRequestHandler):
    asked: dict[str, int] = {}

    def do_GET(self):
        n = self.asked[self.path] = self.asked.get(self.path, 0) + 1
        if self.path == "/gone" or (self.path == "/late" and n < 3):
            self.send_error(503)
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b"x" * 10)

    def log_message(self, *args):
        pass


def test_fetch(spark, tmp_path):
    """Files that are there are skipped, requests tried again three times at most, other failures once; each is a row."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Flaky)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "source.bin").write_bytes(b"abc")
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "4_audio.wav").write_bytes(b"here")
    (folder / "6_audio.wav").write_bytes(b"")
    assets = [(1, "audio", f"{at}/late"), (2, "transcript", f"{at}/gone"), (3, "audio", f"file://{tmp_path}/source.bin"), (4, "audio", f"{at}/never"), (5, "audio", None), (6, "audio", f"{at}/ok"), (7, "audio", "no such scheme"), (8, "transcript", f"file://{tmp_path}/absent")]
    df = spark.createDataFrame(assets, "recording_id long, kind string, url string")
    got = {r.recording_id: r for r in audio.fetch(df, str(folder)).collect()}
    server.shutdown()
    assert {k: (r.ok, r.length) for k, r in got.items()} == {1: (True, 10), 2: (False, 0), 3: (True, 3), 4: (True, 4), 5: (False, 0), 6: (True, 10), 7: (False, 0), 8: (False, 0)}
    assert Flaky.asked == {"/late": 3, "/gone": 3, "/ok": 1} and "503" in got[2].error and got[7].error and got[8].error
    assert sorted(p.name for p in folder.iterdir()) == ["1_audio.wav", "3_audio.wav", "4_audio.wav", "6_audio.wav"]
    assert readers.tally(audio.fetch(df.where("recording_id in (3, 4)"), str(folder))).collect()[0].n == 2


def test_places_are_rounded_as_binary_numbers_are(spark):
    values = [0.0, 0.125, 0.375, 2.675, 1.005, 0.5, -0.125, -2.5, 99.995, 0.995, 1e9 + 0.125, 1234567.885, 0.00005, 5e-324, 1e-9, 73.285, 0.045, 4.35 * 100]
    rng = np.random.default_rng(3)
    values += [*rng.uniform(-100, 100, 300).tolist(), *(rng.integers(0, 10**6, 300) / 800).tolist(), *(rng.integers(0, 10**5, 300) * 0.005).tolist()]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for places in (1, 2, 4, 8):
        got = [r.t for r in df.select(text.fixed(F.col("x"), places).alias("t")).collect()]
        assert got[:-1] == [f"{v:.{places}f}" for v in values] and got[-1] is None


def test_middle_values(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v) if v > 0.1 else None, float(w)) for g, n in (("a", 1), ("b", 2), (None, 501), ("c", 1000)) for v, w in zip(rng.random(n), rng.integers(0, 3, n), strict=True)] + [("d", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    got = {r.g: r for r in order.middles(df, ["v", "w"], ["g"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        for k, c in ((1, "v"), (2, "w")):
            mine = sorted(x[k] for x in rows if x[0] == g and x[k] is not None)
            want = (mine[(len(mine) - 1) // 2], mine[len(mine) // 2]) if mine else (None, None)
            assert (r[f"{c}_low"], r[f"{c}_high"]) == want
    assert order.middles(df.limit(0), ["v"]).first().v_low is None
    stats = df.groupBy("g").agg(F.count("*").alias("n"))
    both = {r.g: (r.n, r.v_high) for r in order.with_middles(stats, order.middles(df, ["v"], ["g"]), ["g"]).collect()}
    assert both["d"] == (1, None) and both[None][0] == 501 and both[None][1] == got[None].v_high


def test_sheets_and_splits(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("user_id,recording_id,language,duration,rec_url_gcp,transcription_url_gcp,metadata_url_gcp\n7,11,hi,3.5,http://a,http://b,\n")
    sheet = readers.catalogue(spark, str(tmp_path / "sheet.csv"))
    assert sheet.first()[:] == (7, 11, "hi", 3.5, "http://a", "http://b", None)
    sheet.write.parquet(str(tmp_path / "sheet.parquet"))
    assert readers.catalogue(spark, str(tmp_path / "sheet.parquet")).collect() == sheet.collect()
    rows = spark.createDataFrame([(1, "train"), (2, "val"), (3, "train")], "k int, split string")
    for _ in range(2):  # overwrites as a whole
        writers.dataset(rows, str(tmp_path / "set"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "set")).select("k", "split").collect()) == [(1, "train"), (2, "val"), (3, "train")]
    assert (tmp_path / "set" / "split=val").is_dir()


def test_long_reports_say_what_is_left_out(spark):
    rows = spark.range(30).withColumnRenamed("id", "k").orderBy("k")
    lines = writers.markdown(rows, "Rows", 4).splitlines()
    assert lines[2:8] == ["| k |", "|---|", "| 0 |", "| 1 |", "| 2 |", "| 3 |"] and lines[-1] == "26 more rows: see the table."
    assert len(writers.markdown(rows, "Rows", 30).splitlines()) == 34
