"""Ranged files, recovery end to end, live interleaving, long tracks, and functions that no table reaches."""

import os
import random
import struct
import time as clock

from pyspark.sql import functions as F

from boxlake.functions import codecs, runs, time
from boxlake.operators import index, mux, playback, session
from boxlake.sources import boxes, recovery, writer
from boxlake.streaming import chunks, gate

SAMPLES = "session string, track int, seq long, start long, stop long, sync boolean, codec string, data binary"


def film(spark, n=40):
    rows = [("f", t, i, i * 400_000, (i + 1) * 400_000, i % 10 == 0, "mp4a" if t else "avc1", bytes([t, i]) * 50) for t in (0, 1) for i in range(n)]
    return spark.createDataFrame(rows, SAMPLES)


def test_a_file_beyond_memory_is_read_by_ranges(spark, tmp_path):
    whole = bytes(writer.encode_sessions(film(spark)).first()["content"])
    tree = boxes.walk(whole)
    movie = tree.find(b"moov")
    path, gap = tmp_path / "large file.mp4", 5 << 30
    with open(path, "wb") as f:  # sparse: a media box of 5 GB before the movie
        f.write(writer.box(b"ftyp", b"mp42", bytes(4)) + struct.pack(">I4sQ", 1, b"mdat", gap))
        f.seek(20 - 4 + gap)
        f.write(whole[movie.offset : movie.offset + movie.length])
    files = boxes.listed(spark, str(path))
    assert files.columns == ["path", "length"] and files.first()["length"] > gap
    assert [r.sample_count for r in boxes.tracks(files).orderBy("track").collect()] == [40, 40]
    assert boxes.movies(files).first()["tracks"] == 2 and not boxes.recovery_needed(files).first()["needed"]
    small = tmp_path / "small.mp4"
    small.write_bytes(whole)
    by_range, by_value = boxes.listed(spark, str(small)), boxes.files(spark, str(small))
    for table in (boxes.boxes, boxes.tracks, boxes.movies, boxes.recovery_needed):
        assert sorted(map(str, table(by_range).collect())) == sorted(map(str, table(by_value).collect()))


def test_recovery_end_to_end(spark, tmp_path):
    """A crash leaves a file without a movie and its index; what comes of them is a whole file with all samples."""
    media = tmp_path / "f"
    log = recovery.LogWriter(str(media))
    log.pin(0, b"vids".ljust(16, b"\0"), b"H264".ljust(16, b"\0"), format=b"SAMP" * 30)
    log.pin(1, b"auds".ljust(16, b"\0"), b"mp4a".ljust(16, b"\0"))
    rows = sorted(film(spark).collect(), key=lambda r: (r.start, r.track))
    with open(media, "wb") as f:
        f.write(writer.box(b"ftyp", b"mp42", bytes(4)) + struct.pack(">I4s", 8, b"mdat"))
        for r in rows:
            at = f.tell()
            f.write(r.data)
            log.sample(r.track, at, recovery.TIME | recovery.STOP | (recovery.SYNC if r.sync else 0), len(r.data), r.start, r.stop - r.start)
        log.sample(0, f.tell(), recovery.TIME, 100, 0, 1)  # its payload was not written any more
    log.flush()
    log.file.write(recovery.SAMPLE + b"torn")
    log.close(finished=False)
    files, logs = boxes.listed(spark, str(media)), boxes.listed(spark, recovery.log_name(str(media)))
    assert boxes.recovery_needed(files).first()["needed"]
    records = recovery.read_log(logs)
    assert records.count() == 81 and [r.track for r in recovery.read_pins(logs).orderBy("track").collect()] == [0, 1]
    assert [r.records for r in recovery.progress(records, 32).collect()] == [81, 81]
    found = recovery.payloads(records, files)
    by_value = recovery.payloads(recovery.read_log(boxes.files(spark, recovery.log_name(str(media)))), boxes.files(spark, str(media)))
    assert sorted(map(str, found.collect())) == sorted(map(str, by_value.collect())) and found.count() == 80
    types = spark.createDataFrame([(0, "avc1"), (1, "mp4a")], "track int, codec string")
    samples = recovery.recovered(found, types).drop("preroll", "discontinuity")
    assert sorted((r.track, r.start, r.stop, r.sync, bytes(r.data)) for r in samples.collect()) == sorted((r.track, r.start, r.stop, r.sync, bytes(r.data)) for r in rows)
    made = writer.write_files(writer.encode_parts(samples), str(tmp_path / "made")).first()["path"]
    recovery.replace_broken(made, str(media))
    after = boxes.listed(spark, str(media))
    assert not boxes.recovery_needed(after).first()["needed"] and not os.path.exists(recovery.log_name(str(media)))
    assert [r.sample_count for r in boxes.tracks(after).orderBy("track").collect()] == [40, 40]


def test_gate():
    g = gate.Gate({0: [], 1: []})
    g.add(0, 5, 0)
    assert list(g.ready()) == []  # track 1 may still come earlier
    g.add(1, 5, 0)
    assert list(g.ready()) == [(0, 0, 5, 0)]  # ties to the lower track, then track 0 is waited for
    g.add(0, 9, 1)
    g.add(0, 12, 2)
    assert list(g.ready()) == [(1, 0, 5, 1)]
    g.add(1, ends=True)
    assert list(g.ready()) == [(0, 1, 9, 2), (0, 2, 12, 3)] and not g.finished()
    g.add(0, 20, 3)
    g.add(0, flush=True)
    g.add(0, 30, 4)
    assert list(g.ready(stopping=True)) == [] and g.finished()


def stream(spark, rows, schema, folder, parts=3):
    folder.mkdir()
    for i in range(parts):
        spark.createDataFrame(rows[len(rows) * i // parts : len(rows) * (i + 1) // parts], schema).coalesce(1).write.parquet(str(folder / f"x={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def finished(spark, df, name, folder):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_as_in_batch(spark, tmp_path):
    rng = random.Random(8)
    at, rows = [0, 0, 0], []
    for i in range(300):
        t = rng.randrange(3)
        at[t] += rng.randrange(1, 3_000_000)
        rows.append((1, t, i, i, at[t], at[t] + 1, rng.randrange(60_000), 400_000 if t else None, i == 299))
    schema = "session long, track long, arrival long, sample long, t long, stop long, size long, frame long, last boolean"
    want = mux.interleave_chunks(spark.createDataFrame(rows, schema)).collect()
    got = finished(spark, gate.interleave_stream(stream(spark, rows, schema, tmp_path / "a")), "interleaved", tmp_path).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.bound for r in want}) > 1

    heads = sorted((r.t_start, r.track, r.chunk) for r in want)
    last = {t: max(c for _, k, c in heads if k == t) for t in range(3)}
    queue = sorted(((r.track, r.chunk, r.t_start) for r in want), key=lambda x: (x[1], x[0]))
    events = [(1, 3, i, t, c, s, "end" if c == last[t] else None) for i, (t, c, s) in enumerate(queue)]
    kinds = "session long, tracks int, seq long, track long, chunk long, t_start long, event string"
    out = finished(spark, gate.gate_stream(stream(spark, events, kinds, tmp_path / "g")), "gated", tmp_path).orderBy("place").collect()
    assert [r.place for r in out] == list(range(len(events))) and {(r.track, r.chunk) for r in out} == {(t, c) for t, c, _ in queue}
    for t in range(3):
        assert [r.chunk for r in out if r.track == t] == sorted(r.chunk for r in out if r.track == t)


def test_one_long_track(spark):
    """What looks forward costs a sort, however long the track is."""
    n = 300_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("track"), F.col("id").alias("sample"), (F.col("id") * 10).alias("t"), (F.col("id") * 10 + 10).alias("stop"), F.lit(4).cast("long").alias("size"), (F.col("id") == 7).alias("is_sync"), (F.col("id") == n - 1).alias("has_time"))
    began = clock.time()
    assert runs.sync_around(rows, "track", "sample", "is_sync").agg(F.sum("sync_next")).first()[0] == 49
    assert mux.macro_samples(rows, "has_time").collect()[0]["n"] == n
    marks = rows.select("track", "sample", F.col("t").alias("cts"), F.lit(10).alias("dur"))
    assert index.nearest_cover(rows.select("track", "t"), marks).where("sample <> t div 10").isEmpty()
    late = rows.select("track", "sample", F.col("t").alias("cts"), F.lit(10).alias("dur"), F.col("is_sync").alias("sync"), F.lit(0).alias("late"))
    assert playback.shed_late(late).count() == n
    assert clock.time() - began < 120


def test_seek_and_positions(spark):
    samples = spark.createDataFrame([(1, i, i * 100, 100, i % 4 == 0) for i in range(20)], "track long, sample long, cts long, dur long, sync boolean")
    edits = spark.createDataFrame([(1, 0, 500, -1), (1, 1, 1000, 200), (1, 2, 300, 0)], "track long, edit int, seg_dur long, media_time long")
    probes = spark.createDataFrame([(1, t) for t in (0, 500, 1150, 1500, 1750, 9000)], "track long, t long")
    got = {r.t: (r.edit, r["sample"]) for r in index.seek(probes, samples, edits).collect()}
    assert got == {0: (1, 0), 500: (1, 0), 1150: (1, 8), 1500: (2, 0), 1750: (2, 0)}
    plain = {r.t: r["sample"] for r in index.seek(probes, samples, edits, to_key=False).collect()}
    assert plain == {0: 2, 500: 2, 1150: 8, 1500: 0, 1750: 2}
    after = {(r.edit, r["sample"]): (r.next_edit, r.next_sample) for r in index.successors(samples, edits).collect()}
    assert after[1, 3] == (1, 4) and after[1, 11] == (2, 0) and after[2, 2] == (None, None)
    one = spark.range(1)
    a, z = session.positions(F.lit(10), F.lit(20), F.lit(5), F.lit(session.RELATIVE), F.lit(7), F.lit(session.INCREMENTAL))
    assert tuple(one.select(a, z).first()) == (15, 22)
    assert one.select(session.same_type(F.struct(F.lit("a"), F.lit(None).cast("int")), F.struct(F.lit("a"), F.lit(None).cast("int")))).first()[0]
    assert one.select(session.frame_duration(F.lit(None).cast("long"), F.lit(25))).first()[0] == 400_000
    props = session.sample_properties(spark.createDataFrame([(1, 2, 3, 4, None)], "track long, sample long, t long, stop long, sync boolean")).first()
    assert tuple(props) == (1, 2, 3, 4, False, False, False)
    assert session.time_flags(samples).where("flags = 17").count() == 5


def test_functions_that_no_table_reaches(spark):
    df = spark.createDataFrame([(1, 48000, 10_000_000)], "a long, scale long, t long")
    assert df.select(time.to_track_rounded(F.lit(104), F.col("scale"))).first()[0] == 0 and df.select(time.to_track_rounded(F.lit(105), F.col("scale"))).first()[0] == 1
    assert df.select(time.bitrate(F.lit(1000), "t")).first()[0] == 8000
    assert df.select(time.interleave(F.lit(8 * (400 << 10) * 2))).first()[0] == 5_000_000 and df.select(time.interleave(F.lit(8))).first()[0] == 10_000_000
    assert recovery.log_name("x.mp4") == "x.mp4-Index.tmp"
    rows = spark.createDataFrame([(0, 10, False), (20, 30, True), (40, 50, False), (90, 99, False)], "t long, stop long, preroll boolean")
    assert [r.t for r in chunks.discard_stream(rows, 5, 80).orderBy("t").collect()] == [0, 40]
    near = spark.createDataFrame([(1, i, i * 4, 4) for i in range(4)] + [(1, 4, 16, 100), (1, 5, 116, 4)], "track long, sample long, offset long, size long")
    assert sorted(r.n for r in runs.coalesce_contiguous(near, "track", "sample", "offset", "size", below=16).collect()) == [1, 1, 4]
    pcm = spark.createDataFrame([(codecs.PCM, 48000, 2), (codecs.PCM, 65536, 2), (codecs.PCM, 8000, 3), (codecs.PCM + 1, 8000, 1)], "tag int, rate int, channels int")
    assert [r[0] for r in pcm.select(codecs.long_pcm(F.col("tag"), F.col("rate"), F.col("channels"))).collect()] == [True, False, False, False]
