"""Index, writing-side, box, codec, recovery and streaming operators on hand-made fixtures."""

import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from boxlake.functions import bits, codecs, eac3, runs, time
from boxlake.operators import index, mux, playback
from boxlake.plans.contract import ORACLE_SQL, QUERIES
from boxlake.sources import boxes, recovery, writer
from boxlake.streaming.chunks import chunk_stream

SF = "/root/testdata/sf0.001"


def table(spark, rows, schema):
    return spark.createDataFrame([(1, *r) for r in rows], f"track long, {schema}")


@pytest.fixture(scope="module")
def one(spark):
    return {
        "stts": table(spark, [(0, 3, 1001), (1, 2, 1000)], "run int, n long, v long"),
        "ctts": table(spark, [(0, 1, 0), (1, 2, 2002), (2, 2, 0)], "run int, n long, v long"),
        "sizes": table(spark, [(i, 10 * i + 10) for i in range(5)], "sample long, size long"),
        "stsc": table(spark, [(0, 1, 2), (1, 3, 1)], "run int, first_chunk long, spc long"),
        "chunks": table(spark, [(0, 100), (1, 500), (2, 900)], "chunk long, offset long"),
    }


def values(df, *columns, by="sample"):
    return [tuple(r[c] for c in columns) for r in df.orderBy(by).collect()]


def test_sample_times(one):
    got = index.sample_times(one["stts"], 30_000, one["ctts"])
    assert values(got, "dts", "dur", "cts") == [(0, 333666, 0), (333666, 333666, 1000999), (667333, 333666, 1334666), (1001000, 333333, 1001000), (1334333, 333333, 1334333)]
    bulk = index.sample_times(one["stts"], 30_000, one["ctts"], compat="bulk_times")
    assert [c for (c,) in values(bulk, "cts")] == [0, 335668, 669335, 1001000, 1334333]
    assert index.total_duration(one["stts"], 30_000).collect()[0]["duration"] == 1667666


def test_offsets_and_lookups(spark, one):
    assert values(index.sample_offsets(one["sizes"], one["stsc"], one["chunks"]), "offset") == [(100,), (110,), (500,), (530,), (900,)]
    short = index.sample_offsets(one["sizes"], one["stsc"], one["chunks"].where("chunk < 2"))
    assert values(short, "offset")[-1] == (0,)
    assert index.time_to_sample(table(spark, [(700_000,)], "t long"), one["stts"], 30_000).collect()[0]["sample"] == 2
    keys = one["sizes"].withColumn("sync", F.col("sample").isin(0, 3))
    around = runs.sync_around(keys, "track", "sample", "sync")
    assert values(around, "sync_before", "sync_next") == [(0, 3), (0, 3), (0, 3), (3, 0), (3, 0)]
    assert values(runs.sync_list(keys, "track", "sample", "sync"), "ordinal", by="ordinal") == [(1,), (4,)]
    assert runs.sync_list(keys.withColumn("sync", F.lit(True)), "track", "sample", "sync").count() == 0


def test_edits(spark, one):
    edits = table(spark, [(0, 2_000_000, -1), (1, 1_000_000, 0)], "edit int, seg_dur long, media_time long")
    samples = index.sample_times(one["stts"], 30_000, one["ctts"])
    assert values(index.edit_map(samples, edits), "sample", "t", "dur") == [(0, 2_000_000, 333_666)]
    assert values(index.edit_map(samples, edits, compat="segment_stop"), "sample") == [(0,)]
    got = index.segment_of(table(spark, [(0,), (2_500_000,)], "t long"), edits)
    assert values(got, "t", "edit", "media", by="t") == [(0, 1, 0), (2_500_000, 1, 500_000)]


def test_runs_round_trip(spark):
    rng = random.Random(1)
    v = [rng.choice([1, 1, 1, 2, None]) for _ in range(200)]
    df = table(spark, list(enumerate(v)), "sample long, v long")
    coded = runs.encode_runs(df, "track", "sample", "v")
    assert [x for (x,) in values(runs.expand_runs(coded, "track"), "v")] == v
    none = table(spark, [(0, 0, 5), (1, 2, 7)], "run int, n long, v long")
    assert values(runs.expand_runs(none, "track"), "sample", "v") == [(0, 7), (1, 7)]


def test_writing_side(spark):
    steady = table(spark, [(i, i * 400_000, i * 400_000 + 400_000) for i in range(12)], "sample long, t long, stop long")
    assert {d for (d,) in values(mux.start_deltas(steady, 360_000), "delta")} == {14400}
    order = [0, 3, 1, 2, 6, 4, 5, 9, 7, 8, 12, 10, 11]
    mixed = table(spark, [(i, p * 400_000, 400_000) for i, p in enumerate(order)], "sample long, t long, dur long")
    got = values(mux.composition_deltas(mixed, 360_000), "delta", "offset")
    assert {d for d, _ in got} == {14400} and [o for _, o in got] == [0] + [28800, -14400, -14400] * 4
    k = 300 << 10
    chunks = mux.fold_chunks(table(spark, [(i, i, None, k) for i in range(3)], "sample long, t long, stop long, size long"))
    assert values(chunks, "first", "n", by="chunk") == [(0, 2), (2, 1)]
    heads = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (1, 0, 3)], "track long, chunk long, t_start long")
    assert values(mux.merge_order(heads), "track", "t_start", by="write_order") == [(1, 3), (0, 5), (0, 1)]


def test_time(spark):
    df = spark.createDataFrame([(30 * 86400 * 10**7, 7), (-7, 2)], "t long, s long")
    assert [r[0] for r in df.select(time.to_track("t", 360_000)).collect()][0] == 30 * 86400 * 360_000
    assert df.select(time.mul_div("t", 1, "s")).collect()[1][0] == -3
    assert spark.range(1).select(time.audio_scale(F.lit(96000))).first()[0] == 45000


@pytest.fixture(scope="module")
def film(spark):
    rows = []
    for t, codec, step in ((0, "raw ", 400_000), (1, "sowt", 200_000)):
        for i in range(40):
            rows.append(("a", t, i, 1_000_000 * t + i * step, 1_000_000 * t + (i + 1) * step, t == 1 or i % 10 == 0, codec, bytes([t, i]) * (i % 5 + 1)))
    df = spark.createDataFrame(rows, "session string, track int, seq long, start long, stop long, sync boolean, codec string, data binary")
    return df, writer.encode_sessions(df).selectExpr("session as path", "content")


def test_written_files_read_back(spark, film):
    rows, files = film
    files = files.cache()
    content = bytes(files.first()["content"])
    t = boxes.tracks(files)
    assert [(r.valid, r.sample_count, r.all_sync, r.codec) for r in t.orderBy("track").collect()] == [(True, 40, False, "raw "), (True, 40, True, "sowt")]
    stts = t.select("track", F.posexplode("stts").alias("run", "x")).select("track", "run", "x.n", "x.v")
    times = index.sample_times(stts, writer.SCALE).where("track = 0")
    assert [x for (x,) in values(times, "dts")] == [i * 400_000 for i in range(40)]
    sizes = t.select("track", F.posexplode("sizes").alias("sample", "size"))
    stsc = t.select("track", F.posexplode("stsc").alias("run", "x")).select("track", "run", "x.first_chunk", "x.spc")
    chunks = t.select("track", F.posexplode("chunk_offsets").alias("chunk", "offset"))
    placed = index.sample_offsets(sizes, stsc, chunks).join(sizes, ["track", "sample"]).collect()
    want = {(r.track, r.seq): bytes(r.data) for r in rows.collect()}
    assert {(r.track, r["sample"]): content[r.offset : r.offset + r.size] for r in placed} == want
    assert t.where("track = 1").first()["edits"][0]["media_time"] == -1
    assert boxes.boxes(files).where("type = 'trak'").count() == 2 and not boxes.recovery_needed(files).first()["needed"]


def test_parts_of_files(spark, film, tmp_path):
    rng = random.Random(2)
    rows = [(s, t, i, i * 1000 + 5000 * t, None if i % 7 == 0 else i * 1000 + 900 + 5000 * t, i % 4 == 0, "avc1" if t else "mp4a", None if i == 3 else rng.randbytes(rng.randrange(50))) for s in "ab" for t in range(3) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, 0, 0, 0, 0, True, "avc1", b"x"), ("a", 0, 500, None, 0, True, "avc1", b"x")], "session string, track int, seq long, start long, stop long, sync boolean, codec string, data binary")
    parts = writer.encode_parts(df, 300, 20_000, media_bytes=1500, comment="x").cache()
    files = {s: b"".join(bytes(r.content) for r in sorted((r for r in parts.collect() if r.session == s), key=lambda r: r.part)) for s in "ab"}
    written = writer.write_files(parts, str(tmp_path / "out")).collect()
    assert {r.session: open(r.path, "rb").read() for r in written} == files and [r.bytes for r in written] == [len(files[r.session]) for r in written]
    assert len(list((tmp_path / "out").iterdir())) == 2
    for s, data in files.items():
        top = boxes.walk(data).children
        media = [b for b in top if b.kind == b"mdat"]
        assert [b.kind for b in top] == [b"ftyp"] + [b"mdat"] * len(media) + [b"moov"] and len(media) > 3 and data[8:12] == b"mp42"
        assert all(b.length >= 1508 for b in media[:-1]) and boxes.movie(data)["comment"] == "x"
        assert next(c for c in top[-1].children if c.kind == b"iods").payload(data)[4:6] == bytes([16, 7 + 3 * 6])
        heads = []
        for t, track in enumerate(boxes.movie(data)["tracks"]):
            own = [r for r in rows if r[0] == s and r[1] == t]
            spc = [n for (a, n), (z, _) in zip(track["stsc"], [*track["stsc"][1:], (len(track["chunk_offsets"]) + 1, 0)], strict=True) for _ in range(a, z)]
            at = 0
            for offset, n in zip(track["chunk_offsets"], spc, strict=True):
                content = b"".join(r[7] or b"" for r in own[at : at + n])
                assert data[offset : offset + len(content)] == content
                heads.append((offset, own[at][3], t))
                at += n
            assert at == 120 and track["sync"] == list(range(1, 121, 4)) and track["valid"]
        assert [h[1:] for h in sorted(heads)] == sorted(h[1:] for h in heads)
    assert writer.encode_parts(df.where("false")).count() == 0


def test_metadata_and_broken_files(spark):
    data = writer.movie_box([], "note é", [("WM/a", "x"), ("WM/a", "ü")])
    m = boxes.movie(data)
    assert m["comment"] == "note é" and m["attributes"] == [("WM/a", "x"), ("WM/a", "ü")]
    broken = [b"", writer.box(b"ftyp", b"qt  "), writer.box(b"ftyp") + struct.pack(">I4s", 8, b"mdat") + data, data + b"\0\0\1\0free", data]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(broken)], "path string, content binary")
    assert [r.needed for r in boxes.recovery_needed(df).orderBy("path").collect()] == [True, True, True, True, False]
    assert boxes.walk(struct.pack(">I4s", 100, b"moov")).children == []


def test_recovery_log(spark):
    log = recovery.header() + recovery.pin_record(0, bytes(16), b"H264" + bytes(12), format=b"SAMP IPIN junk") + recovery.sample_record(1, 4, 1, 3, 10, 5) + recovery.sample_record(0, 90, 0, 3, 20, 5) + recovery.SAMPLE
    logs = spark.createDataFrame([("f-Index.tmp", log)], "path string, content binary")
    media = spark.createDataFrame([("f", b"0123abc")], "path string, content binary")
    got = recovery.read_log(logs)
    assert got.count() == 2
    assert [bytes(r.data) for r in recovery.payloads(got, media).collect()] == [b"abc"]


def test_codecs(spark):
    w = bits.write_bits
    golomb = lambda n: (n + 1, 2 * (n + 1).bit_length() - 1)
    sps = bytes([0x67]) + w([(66, 8), (0xC0, 8), (30, 8), golomb(0), golomb(0), golomb(2), golomb(1), (0, 1), golomb(44), golomb(29), (1, 1), (1, 1), (0, 1), (0, 1), (1, 1)])
    assert bits.sequence_parameters(sps) == {"profile": 66, "compatible": 0xC0, "level": 30, "width": 720, "height": 480, "interlaced": False}
    assert bits.sequence_parameters(sps[:4]) is None and bits.sequence_parameters(b"") is None
    assert [bits.Bits(w([golomb(n)])).unsigned() for n in (0, 1, 7, 255)] == [0, 1, 7, 255]
    stream = b"\0\0\0\1" + sps + b"\0\0\1\x65abc"
    assert bits.prefixed_units(bits.to_prefixed(stream)) == [sps, b"\x65abc"] and bits.to_start_codes(bits.to_prefixed(stream)) == stream
    assert bits.raw_payload(b"\0\0\3\1") == b"\0\0\1"
    for n in (3, 200, 20_000):
        assert bits.descriptor(bits.compose_descriptor(5, bytes(n))) == (5, bytes(n), n + 1 + (1 if n < 128 else 2 if n < 16384 else 3))
    entry = writer.Track("soun", b"mp4a", specific=b"\x11\x90").entry()
    assert bits.elementary_stream(entry[entry.index(b"esds") + 8 :]) == {"object_type": 0x40, "mpeg_audio": False, "specific": b"\x11\x90"}
    assert bits.audio_config(b"\x11\x90") == {"object_type": 2, "rate": 48000, "channels": 2}
    frame = w([(0xFFF, 12), (0, 1), (0, 2), (1, 1), (1, 2), (3, 4), (0, 1), (2, 3), (0, 4), (10, 13), (0x7FF, 11), (0, 2)]) + b"abc"
    assert bits.without_adts(frame) == b"abc" and bits.without_adts(b"abc") == b"abc"
    assert bits.ac3_frame(w([(0x0B77, 16), (0, 16), (0, 2), (20, 6), (8, 5), (0, 3), (7, 3), (0, 2), (0, 2), (1, 1), (0, 7)])) == {"rate": 48000, "kbits": 192, "mode": 0, "channels": 6, "lfe": True}
    assert bits.swapped(b"\1\2\3\4\5") == b"\2\1\4\3\5"
    df = spark.createDataFrame([(sps,), (None,), (b"x",)], "d binary")
    assert [r.w for r in df.select(bits.sps_column("d").alias("s")).select(F.col("s.width").alias("w")).collect()] == [720, None, None]


def test_slices_and_enhancements(spark):
    golomb = lambda n: (n + 1, 2 * (n + 1).bit_length() - 1)
    body = bits.write_bits([golomb(0), golomb(7), golomb(2), (9, 4), (0xFFFF, 16)])
    assert [bits.slice_frame_number(bytes([k]) + body, 4) for k in (0x65, 0x61, 0x67)] == [9, 9, None]
    assert bits.slice_frame_number(b"", 4) is None and bits.slice_frame_number(b"\x65", 4) is None
    assert bits.enhancement(b"\x06" + b"\xff" * 2 + b"\x05" + b"\xff\x00" + bytes(255)) == {"type": 515, "length": 255, "at": 6}
    assert bits.enhancement(b"\x06\x0a\x03abc") == {"type": 10, "length": 3, "at": 3} and bits.enhancement(b"\x06\xff") is None
    df = spark.createDataFrame([(b"\x06\x05\x03abc",), (None,), (b"",)], "d binary")
    assert [r.n for r in df.select(bits.enhancement_column("d").alias("s")).select(F.col("s.length").alias("n")).collect()] == [3, None, None]


def eac3_frame(kind, substream, size, mode=7, lfe=1, tail=(), rate=(0, 3)):
    """Header fields up to the place of a dependent frame's map, then ``tail``, padded to ``size`` bytes."""
    head = [(0x0B77, 16), (kind, 2), (substream, 3), (size // 2 - 1, 11), (rate[0], 2), (rate[1], 2), (mode, 3), (lfe, 1), (16, 5)]
    head += [(27, 5), (0, 1)] * (2 if mode == 0 else 1)
    return bits.write_bits([*head, *tail]).ljust(size, b"\0")


def test_enhanced_ac3(spark):
    plain = eac3_frame(0, 0, 768, tail=[(0, 1), (1, 1), (5, 3)])
    assert eac3.frame(plain) == {"kind": 0, "substream": 0, "size": 768, "rate_code": 0, "rate": 48000, "blocks": 6, "bitrate": 192000, "mode": 7, "lfe": True, "stream": 16, "locations": 0, "service": 5}
    low = eac3.frame(eac3_frame(0, 0, 100, rate=(3, 1)))
    assert (low["rate"], low["blocks"], low["service"]) == (22050, 6, 0)
    assert eac3.frame(eac3_frame(0, 0, 100, rate=(3, 3))) is None and eac3.frame(plain[:4]) is None and eac3.frame(b"\0" * 99) is None
    # All mixing fields of five channels: levels, a flagged level, two flagged scales, option 3 of 4 bytes, six flagged blocks.
    mixing = [(1, 1), (0, 2), (0, 6), (0, 6), (1, 1), (31, 5), (1, 1), (63, 6), (0, 1), (3, 2), (2, 5), (0xFFFFFFFF, 32), (1, 1), *[(1, 1), (31, 5)] * 6]
    assert eac3.frame(eac3_frame(0, 0, 768, tail=[*mixing, (1, 1), (6, 3)]))["service"] == 6
    dual = [(1, 1), (1, 1), (63, 6), (0, 1), (0, 1), (1, 2), (31, 5), (1, 1), (0x3FFF, 14), (0, 1), (1, 1), (31, 5)]
    assert eac3.frame(eac3_frame(0, 0, 96, mode=0, lfe=0, tail=[*dual, (1, 1), (3, 3)], rate=(0, 0)))["service"] == 3
    side = eac3_frame(1, 0, 384, tail=[(1, 1), (0x4020, 16), (0, 1), (0, 1)])
    assert eac3.frame(side)["locations"] == 0x101
    assert [(h["kind"], h["substream"]) for h in eac3.substreams(plain + side + eac3_frame(0, 1, 100) + plain + b"junk")] == [(0, 0), (1, 0), (0, 1)]
    assert eac3.substreams(plain + b"junk") is None and eac3.substreams(b"") == []
    assert eac3.decoder_box([eac3.frame(plain)]) == bits.write_bits([(192, 13), (0, 3), (0, 2), (16, 5), (5, 5), (7, 3), (1, 1), (0, 3), (0, 4), (0, 1)])
    assert eac3.decoder_box(eac3.substreams(plain + side)) == bits.write_bits([(288, 13), (0, 3), (0, 2), (16, 5), (5, 5), (7, 3), (1, 1), (0, 3), (1, 4), (0x101, 9)])
    df = table(spark, [(1, b"late"), (0, plain + side)], "sample long, data binary").union(spark.createDataFrame([(2, 0, b"no"), (3, 0, None)], "track long, sample long, data binary"))
    found = eac3.substream_table(df).cache()
    assert [(r.track, r.frame, r.kind, r.lfe) for r in found.orderBy("frame").collect()] == [(1, 0, 0, True), (1, 1, 1, True)]
    assert [tuple(r) for r in eac3.independent_substreams(found).select("substream", "n_dependent", "locations").collect()] == [(0, 1, 0x101)]
    assert [tuple(r) for r in eac3.track_rates(found).collect()] == [(1, 288_000, 1)]


def test_shed_late(spark):
    def slow(rows, rate, last):
        out, k = [], 0
        while k < len(rows):
            n, cts, dur, _, late = rows[k]
            frame = int(dur / rate)
            late = (late or 0) + (frame if (late or 0) > 2 * frame else 0)
            while late > frame // 2:
                after = next((j for j in range(k + 1, len(rows)) if rows[j][3]), None)
                if after is None or (last is not None and rows[after][0] > last):
                    break
                way = int((rows[after][1] - rows[k][1]) / rate)
                if rows[after][0] != rows[k][0] + 1 and int(way / 2) >= late:
                    break
                late, k = late - way, after
            out.append(rows[k][0])
            k += 1
        return out

    rng = random.Random(3)
    for rate, last in ((1.0, None), (2.0, None), (1.0, 60)):
        rows = [(i, i * 400, 400, rng.random() < 0.3, rng.choice([None, 0, 150, 500, 900, 2500])) for i in range(120)]
        df = table(spark, rows, "sample long, cts long, dur long, sync boolean, late long").withColumn("_k", F.lit("x"))
        got = playback.shed_late(df.withColumnRenamed("_k", "next"), rate, last)
        assert [x for (x,) in values(got, "sample")] == slow(rows, rate, last) and got.columns[-1] == "next"
    assert playback.shed_late(df.where("false").drop("_k")).count() == 0


def test_chunk_stream(spark, tmp_path):
    rows = [(1, i, i * 10, None, 200_000, i == 6) for i in range(7)] + [(2, 0, 5, 9, 1, False)]
    df = spark.createDataFrame(rows, "track long, sample long, t long, stop long, size long, last boolean")
    for k in range(2):
        df.where(f"sample % 7 {'<' if not k else '>='} 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = chunk_stream(stream).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("chunks").where("track = 1").orderBy("chunk").collect()
    assert [(r["first"], r["n"], r["bytes"]) for r in got] == [(0, 3, 600_000), (3, 3, 600_000), (6, 1, 200_000)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_contract_query(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    names = [c[0] for c in want.description]
    rows = sorted(str([r[names.index(c)] for c in columns]) for r in want.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == rows


def test_lookups_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        stts = [(i, rng.choice([0, 1, 3, 8]), rng.choice([0, 1, 7, 1000])) for i in range(30)] + [(30, 1, 5)]
        bounds, t0, s0 = [], 0, 0
        for _, n, v in stts:
            if n:
                bounds.append((t0, s0, n, v))
            t0, s0 = t0 + n * v * 1000, s0 + n
        times = [(rng.randrange(t0 + 5000),) for _ in range(80)] + [(b[0],) for b in bounds]
        run = lambda t: max(i for i, b in enumerate(bounds) if b[0] <= t)
        want = sorted((t, bounds[run(t)][1] + (t - bounds[run(t)][0]) // max(1, bounds[run(t)][3] * 1000)) for (t,) in times)
        got = index.time_to_sample(table(spark, times, "t long"), table(spark, stts, "run int, n long, v long"), 10_000)
        assert sorted((r.t, r["sample"]) for r in got.collect()) == want
        samples = [(i, rng.randrange(-50, 900), rng.choice([0, 5, 60])) for i in range(60)]
        probes = sorted({(rng.randrange(1000),) for _ in range(60)})
        near = index.nearest_cover(table(spark, probes, "t long"), table(spark, samples, "sample long, cts long, dur long"))
        first = [(t, min((i for i, c, d in samples if c >= 0 and d > 0 and t < c + d), default=-1)) for (t,) in probes]
        assert sorted((r.t, r["sample"]) for r in near.collect()) == first


def picture(width, height, depth=24, *parts):
    return bytes(24) + struct.pack(">HH", width, height) + bytes(46) + struct.pack(">HH", depth, 0xFFFF) + b"".join(parts)


def sound(channels, size, rate, *parts, version=0):
    return bytes(8) + struct.pack(">H", version) + bytes(6) + struct.pack(">HHII", channels, size, 0, rate << 16) + b"".join(parts)


def es(kind, specific=b""):
    config = bytes([kind, 0x15]) + bytes(11) + (bits.compose_descriptor(5, specific) if specific else b"")
    return writer.full(b"esds", bits.compose_descriptor(3, bytes(3) + bits.compose_descriptor(4, config)))


def test_sample_descriptions(spark):
    avc = bits.compose_avc_configuration(b"\0\0\1\x67\x42\xc0\x1eab\0\0\1\x68cd")
    given = [
        ("avc1", picture(720, 480, 24, writer.box(b"avcC", avc))), ("avc1", picture(720, 480)), ("mp4v", picture(8, 6, 24, es(0x20, b"\0\0\1\x20z"))),
        ("mjpa", picture(64, 32)), ("HapY", picture(64, 32, 32)), ("\0\0\0\0", picture(4, 4, 32)), ("mp4a", sound(2, 16, 44100, es(0x40, b"\x11\x90"))),
        ("mp4a", sound(1, 16, 32000, es(0x6B))), ("mp4a", sound(2, 16, 44100, writer.box(b"wave", writer.box(b"frma"), es(0x40, b"\x12\x08")), version=1)),
        ("in24", sound(2, 16, 48000)), ("twos", sound(1, 16, 8000)), ("c608", b""), ("avc1", b"short"), ("hvc1", picture(1, 1)), (None, b""), ("sowt", None),
    ]
    given[8] = ("mp4a", given[8][1][:28] + bytes(16) + given[8][1][28:])
    df = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(given)], "track int, codec string, entry binary")
    rows = codecs.sample_entries(df).withColumn("types", codecs.offered_types()).withColumn("shown", codecs.display_name("description.name", "track")).orderBy("track").collect()
    assert [(r.description.kind, r.description.valid) if r.description else None for r in rows] == [
        ("h264", True), ("h264", False), ("mpeg4", True), ("picture", True), ("picture", True), ("rgb", True), ("aac", True), ("mpeg_audio", True), ("aac", True),
        ("pcm", True), ("pcm", True), ("text", True), ("h264", False), None, None, None,
    ]
    assert [[(t.subtype, t.handler) for t in r.types] for r in rows][:12] == [
        [("H264 stream", "plain"), ("H264", "start_codes")], [], [("MP4V", "plain"), ("XVID", "first_header"), ("DIVX", "first_header")], [("MJPG", "plain")], [("hapy", "plain")],
        [("RGB32", "plain")], [("AAC", "plain")], [("MPEG2 audio", "plain")], [("AAC", "plain")], [("PCM", "plain")], [("PCM", "swapped")], [("byte pair", "plain")],
    ]
    d = [r.description for r in rows]
    assert (d[0].width, d[0].height, d[6].rate, d[6].channels, d[8].rate, d[9].bytes_per_second, d[10].block_align) == (720, 480, 48000, 2, 44100, 288_000, 2)
    assert rows[3].shown == "Motion JPEG Video 4"


def test_writer_types(spark):
    names = "major string, subtype string, format string, tag int, bits int, compression int, image_size int, sample_size int, length_field int"
    none = (None,) * 6
    given = [
        (("video", "DIVX", "videoinfo", *none), "divx"), (("video", "DIVX", "videoinfo2", *none), None), (("video", "AVC1", "mpeg2video", *none[:5], 4), "h264_prefixed"),
        (("video", "AVC1", "mpeg2video", *none[:5], 0), "h264_start_codes"), (("video", "x264", "uvch264", *none), "h264_start_codes"), (("video", "RGB24", "videoinfo", None, 24, 0, 9, 9, None), "picture"),
        (("video", "RGB24", "videoinfo", None, 32, 0, 9, 9, None), None), (("video", "NV12", "videoinfo", None, 12, 7, 9, 8, None), None), (("video", "mjpg", "videoinfo", *none), "picture"),
        (("audio", "any", "waveformatex", 0x1234, *none[:5]), "aac"), (("audio", "any", "waveformatex", 7, *none[:5]), "wave"), (("audio", "DDPLUS", "waveformatex", 0, *none[:5]), "eac3"),
        (("audio", "MP3", "waveformatex", 0x55, *none[:5]), "mp3"), (("audio", "AC3", "waveformatex", 0x2000, *none[:5]), "ac3"), (("audio", "PCM", "other", 1, *none[:5]), None),
        (("line21", "byte pair", None, *none), "text"), ((None, None, None, *none), None),
    ]
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(given)], f"i int, {names}")
    assert [r.h for r in df.withColumn("h", codecs.writer_handler()).orderBy("i").collect()] == [h for _, h in given]
    one = spark.range(1).select(codecs.object_type(F.lit(4)).alias("o"), codecs.audio_object_type(F.lit(0x50), F.lit(False)).alias("a"), codecs.long_pcm(F.lit(1), F.lit(48000), F.lit(2)).alias("p")).first()
    assert tuple(one) == (0x63, 0x69, True)


def test_payload_changes(spark):
    sps, pps = b"\x67\x42\xc0\x1eab", b"\x68cd"
    c = bits.compose_avc_configuration(b"\0\0\0\1" + sps + b"\0\0\1" + pps + b"\0\0\1\x65x")
    got = bits.avc_configuration(c)
    assert (got["profile"], got["level"], got["length_size"], got["sps"], got["pps"]) == (0x42, 0x1E, 4, [sps], [pps])
    assert bits.avc_configuration(c[:9])["sps"] == [] and bits.avc_configuration(b"") is None and bits.compose_avc_configuration(sps) is None
    short = c[:4] + b"\xfd" + c[5:]
    mark = b"\0\0\0\1"
    assert bits.byte_stream(b"\0\2\x65x\0\1\x41", short, True) == mark + sps + mark + pps + mark + b"\x65x" + mark + b"\x41"
    assert bits.byte_stream(b"\0\2\x65x", short, False) == mark + b"\x65x" and bits.byte_stream(b"\0\xffx", short, False) is None
    assert bits.first_header(b"junk\0\0\1\x25abc") == b"\0\0\1\x25abc" and bits.first_header(b"junk") == b""
    assert bits.layer_header(b"\0\0\1\xb0p\0\0\1\x20vol\0\0\1\xb6f") == b"\0\0\1\x20vol" and bits.layer_header(b"\0\0\1\x20vol") is None
    pcm = spark.createDataFrame([(0, 10_000_000, bytes(range(100)), 50, 2), (10_000_000, 20_000_000, b"x", 50, 2), (0, None, b"abcd", 50, 2)], "t long, stop long, data binary, rate int, block int")
    cut = mux.trim_pcm(pcm, 4_100_000).collect()
    assert (cut[0].t, bytes(cut[0].data)) == (4_100_000, bytes(range(40, 100))) and (cut[1].t, bytes(cut[2].data)) == (10_000_000, b"abcd")


def test_interleave(spark):
    rng = random.Random(9)
    rows = sorted((s, rng.randrange(3), i, i // 2, i * 1000 + rng.randrange(3000), rng.choice([0, 10, 400, 900])) for s in range(3) for i in range(150))
    rows = [(s, t, i, a, x, None if i % 9 == 0 else x + 700, z, 800 if t == 0 else None) for s, t, i, a, x, z in rows]
    want = []
    for s in range(3):
        bound, open_, best, count = 40_000, {}, {}, {}
        for _, t, i, _, x, y, z, f in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1], r[2])):
            c = open_.setdefault(t, [])
            c.append((i, x, x + 1 if y is None else y, z))
            size, a, e = sum(q[3] for q in c), min(q[1] for q in c), max(q[2] for q in c)
            length = e - a if f is None else len(c) * f
            if size > 5000 or length > bound:
                want.append((s, t, count.get(t, 0), c[0][0], len(c), size, a, e, bound))
                count[t] = count.get(t, 0) + 1
                rate = size * 10_000_000 // length * 8
                if rate > best.get(t, 0):
                    best[t] = rate
                    bound = min(bound, 10_000_000 * 8 * 5000 // sum(best.values()))
                del open_[t]
        want += [(s, t, count.get(t, 0), c[0][0], len(c), sum(q[3] for q in c), min(q[1] for q in c), max(q[2] for q in c), bound) for t, c in open_.items()]
    df = spark.createDataFrame(rows, "session long, track long, sample long, arrival long, t long, stop long, size long, frame long")
    got = mux.interleave_chunks(df, 5000, 40_000)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert mux.interleave_chunks(df.where("false")).count() == 0
    assert min(r[8] for r in want) < 40_000
