"""Descriptions of written tracks read back, change of metadata in files, padded files, recovered streams, cancelled bounds."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from boxlake.functions import bits, codecs
from boxlake.operators import mux
from boxlake.sources import boxes, entries, metadata, recovery, writer

W = bits.write_bits
AC3 = W([(0x0B77, 16), (0, 16), (0, 2), (20, 6), (8, 5), (0, 3), (7, 3), (0, 2), (0, 2), (1, 1), (0, 7)]) + bytes(40)
EC3 = W([(0x0B77, 16), (0, 2), (0, 3), (31, 11), (0, 2), (3, 2), (7, 3), (1, 1), (16, 5), (0, 5), (0, 1), (0, 1), (0, 1), (0, 5)]).ljust(64, b"\0")
SPS, PPS = b"\x67\x42\xc0\x1e\xda\x02\x80\xbf", b"\x68\xce\x38\x80"
SAMPLE = "session string, track int, seq long, start long, stop long, sync boolean, codec string, data binary"
TYPE = "session string, track int, handler string, code string, tag int, object_type int, width int, height int, channels int, bits int, rate int, specific binary"


def types():
    a = ("a",)
    return [
        (*a, 0, "h264_start_codes", None, None, None, 640, 480, None, None, None, None),
        (*a, 1, "divx", None, None, None, 320, 240, None, None, None, b"\0\0\1\x20abc"),
        (*a, 2, "mpeg2_video", None, None, 0x61, 720, 576, None, None, None, b"seq"),
        (*a, 3, "picture", "YUY2", None, None, 8, 6, None, None, None, None),
        (*a, 4, "picture", "MJPG", None, None, 8, 6, None, None, None, None),
        (*a, 5, "aac", None, None, None, None, None, 2, None, 48000, None),
        (*a, 6, "mp3", None, None, None, None, None, 2, None, 44100, None),
        (*a, 7, "mpeg_audio", None, None, 0x6B, None, None, 1, None, 32000, None),
        (*a, 8, "wave", None, codecs.PCM, None, None, None, 2, 16, 44100, None),
        (*a, 9, "wave", None, codecs.ULAW, None, None, None, 1, 8, 8000, None),
        (*a, 10, "ac3", None, None, None, None, None, 6, None, 48000, None),
        (*a, 11, "eac3", None, None, None, None, None, 6, None, 48000, None),
        (*a, 12, "text", None, None, None, None, None, None, None, None, None),
        (*a, 13, "nothing", None, None, None, None, None, None, None, None, None),
        (*a, 14, "ac3", None, None, None, None, None, 6, None, 48000, None),  # its payloads are no frames
        (None, 15, "aac", None, None, None, None, None, 2, None, 48000, None),
    ]


@pytest.fixture(scope="module")
def files(spark):
    first = {0: bits.to_prefixed(b"\0\0\0\1" + SPS + b"\0\0\0\1" + PPS + b"\0\0\1\x65xy"), 10: AC3, 11: EC3}
    rows = [("a", t, i, i * 400_000, (i + 1) * 400_000, True, "raw ", first.get(t, b"abc") if i else b"") for t in range(15) for i in range(4)]
    samples = spark.createDataFrame(rows, SAMPLE)
    found = entries.sample_descriptions(spark.createDataFrame(types(), TYPE), samples)
    return writer.encode_sessions(samples, entries=found, comment="before").selectExpr("session as path", "content").cache()


def test_descriptions_read_back(files):
    got = {r.track: r for r in codecs.sample_entries(boxes.tracks(files)).collect()}
    assert len(got) == 15 and all(r.valid for r in got.values())
    codes = {t: r.codec for t, r in got.items()}
    assert [codes[t] for t in range(15)] == ["avc1", "mp4v", "mp4v", "YUY2", "jpeg", "mp4a", "mp4a", "mp4a", "sowt", "ulaw", "ac-3", "ec-3", "c608", "raw ", "raw "]
    d = {t: r.description for t, r in got.items()}
    assert [(d[t].width, d[t].height) for t in (0, 1, 2, 3)] == [(640, 480), (320, 240), (720, 576), (8, 6)]
    record = bits.avc_configuration(bytes(d[0].specific))
    assert record["sps"] == [SPS] and record["pps"] == [PPS] and record["length_size"] == 4
    assert bytes(d[1].specific) == b"\0\0\1\x20abc" and bytes(d[2].specific) == b"seq" and d[1].valid
    assert (d[5].kind, d[5].rate, d[5].channels) == ("aac", 48000, 2) and d[6].kind == d[7].kind == "mpeg_audio"
    assert (d[8].kind, d[8].channels, d[8].bits, d[8].rate, d[8].block_align) == ("pcm", 2, 16, 44100, 4)
    assert struct.unpack("<HHIIHHH", bytes(d[9].specific)) == (codecs.ULAW, 1, 8000, 8000, 1, 8, 0)
    entry = {t: bytes(r.entry) for t, r in got.items()}
    at = entry[10].index(b"dac3") + 4
    b = bits.Bits(entry[10][at : at + 3])
    assert [b.read(n) for n in (2, 5, 3, 3, 1, 5, 5)] == [0, 8, 0, 7, 1, 10, 0]
    at = entry[11].index(b"dec3") + 4
    b = bits.Bits(entry[11][at : at + 5])
    assert [b.read(n) for n in (13, 3, 2, 5, 5, 3, 1, 3, 4)] == [16, 0, 0, 16, 0, 7, 1, 0, 0]
    kinds = boxes.tracks(files).select("track", "handler").collect()
    assert {r.track: r.handler for r in kinds if r.track in (0, 5, 12)} == {0: "vide", 5: "soun", 12: "text"}


def test_configurations():
    assert entries.aac_configuration(b"", 48000, 8) == W([(2, 5), (3, 4), (7, 4), (0, 3)])
    assert entries.aac_configuration(b"\x01\x90", 48000, 2) == b"\x11\x90" and entries.aac_configuration(b"\x01\x90\x56", 1, 2) == b"\x01\x90\x56"
    assert entries.described(1, {}, b"") is None and entries.described(1, {"handler": "eac3"}, b"") is None and entries.described(1, {"handler": "h264_prefixed"}, b"junk") is None
    assert entries.described(1, {"handler": "wave", "tag": 0x1234}, b"") is None
    assert [bits.swapped(bytes(range(9)), n) for n in (2, 4, 8)] == [b"\1\0\3\2\5\4\7\6\x08", b"\3\2\1\0\7\6\5\4\x08", b"\7\6\5\4\3\2\1\0\x08"] and bits.swapped(b"", 4) == b""


def samples_of(data):
    out = []
    for t in boxes.movie(data)["tracks"]:
        spc = [n for (a, n), (z, _) in zip(t["stsc"], [*t["stsc"][1:], (len(t["chunk_offsets"]) + 1, 0)], strict=True) for _ in range(a, z)]
        sizes, rest = iter(t["sizes"] or [t["fixed_size"]] * t["sample_count"]), []
        for at, n in zip(t["chunk_offsets"], spc, strict=True):
            for size in [next(sizes) for _ in range(n)]:
                rest.append(data[at : at + size])
                at += size
        out.append(rest)
    return out


def test_comment_and_attributes_change(spark, files, tmp_path):
    data = bytes(files.first()["content"])
    assert boxes.movie(data)["comment"] == "before" and metadata.patches(data, "before") == []
    media = writer.box(b"free", b"zz")[8:]
    open_end = data + struct.pack(">I4s", 0, b"mdat") + media  # an open media box behind the movie
    for old in (data, open_end):
        new = bytes(metadata.changed_contents(spark.createDataFrame([("f", old)], "path string, content binary"), "after é", [("WM/a", "x")]).first()["content"])
        m = boxes.movie(new)
        assert m["comment"] == "after é" and m["attributes"] == [("WM/a", "x")] and samples_of(new) == samples_of(data)
        assert m["tracks"] == boxes.movie(data)["tracks"] and [b.kind for b in boxes.walk(new).children].count(b"moov") == 1
        again = metadata.patched(new, metadata.patches(new, attributes=[]))
        assert boxes.movie(again)["comment"] == "after é" and boxes.movie(again)["attributes"] == []
    assert metadata.patches(data + b"\0\0\1\0free", "x") == [] and metadata.patches(b"", "x") == []

    path = tmp_path / "f.mp4"
    path.write_bytes(data)
    done = metadata.change_files(boxes.listed(spark, str(path)), "in place").collect()
    assert len(done) == 1 and done[0].bytes == path.stat().st_size and boxes.movie(path.read_bytes())["comment"] == "in place"
    before = path.read_bytes()
    metadata.change_file(str(path), "in place")
    assert path.read_bytes() == before  # a repeated task
    path.write_bytes(before + b"\0\0\5\0moovtorn")  # a task that was lost while it wrote
    (tmp_path / ("f.mp4" + metadata.JOURNAL)).write_text(f"{len(before)}\n")
    metadata.change_file(str(path), "second")
    assert boxes.movie(path.read_bytes())["comment"] == "second" and samples_of(path.read_bytes()) == samples_of(data)
    assert os.listdir(tmp_path) == ["f.mp4"]
    assert boxes.movies(boxes.listed(spark, str(path))).first()["comment"] == "second" and not boxes.recovery_needed(boxes.listed(spark, str(path))).first()["needed"]


@pytest.mark.parametrize("more", [0, 3, 8, 100])
def test_padded_files(spark, tmp_path, more):
    parts = spark.createDataFrame([("s", i, bytes([i]) * 10) for i in range(5)], "session string, part long, content binary")
    got = writer.write_files(parts, str(tmp_path), combine=16, preallocate=50 + more).first()
    data = open(got.path, "rb").read()
    assert data[:50] == b"".join(bytes([i]) * 10 for i in range(5)) and got.bytes == 50
    assert len(data) == 50 + (more if more >= 8 else 0)
    if more >= 8:
        assert struct.unpack(">I4s", data[50:58]) == (more, b"free")


def test_recovered_streams(spark):
    unit = b"\x65abc"
    rows = [("f" + recovery.SUFFIX, i, i, 0, recovery.TIME, 0, i, 1, d) for i, d in enumerate((bits.to_prefixed(b"\0\0\0\1" + SPS + b"\0\0\1" + unit), b"\0\0\0\1x", None))]
    found = spark.createDataFrame(rows, recovery._DATA)
    named = spark.createDataFrame([(0, "avc1"), (2, "avc1")], "track int, codec string")
    got = {r.track: r.data and bytes(r.data) for r in recovery.recovered(found, named, start_codes=True).collect()}
    assert got == {0: b"\0\0\0\1" + SPS + b"\0\0\1" + unit, 1: b"\0\0\0\1x", 2: None}


def test_cancelled_bounds(spark):
    df = spark.range(10).select(F.lit(0).alias("track"), F.col("id").alias("sample"), (F.col("id") * 10).alias("t"), (F.col("id") * 10 + 10).alias("stop"))
    for monotone in (True, False):
        cut = lambda a, z: sorted(r["sample"] for r in mux.discard_range(df, a, z, monotone).collect())  # noqa: E731, B023
        assert cut(None, None) == list(range(10)) and cut(30, None) == list(range(3, 10)) and cut(None, 30) == [0, 1, 2] and cut(20, 50) == [2, 3, 4]
