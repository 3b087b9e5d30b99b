"""The write-ahead index of a file that is being written, and what can be made of it after a crash."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.functions.bits import start_code_column
from boxlake.sources.boxes import Data, Ranged, _map

#: Signatures and layouts of the records, little-endian and packed; a pin's type is a structure of the
#: system's (major type, subtype, two flags, size of samples, kind of format, two pointers, bytes of the format) with the
#: format itself behind it.
HEADER, PIN, SAMPLE = b"MP4I", b"IPIN", b"SAMP"
_SAMPLE = struct.Struct("<4sHQIIQI")
_PIN = struct.Struct("<4sH16s16siiI16s4xQI4xQ")
#: Bits of a sample's flags.
SYNC, PREROLL, DISCONTINUITY, TIME, STOP = 1, 2, 4, 16, 256
LOG = "path string, ordinal long, track int, position long, flags int, size long, start long, length long"
PINS = "path string, track int, major binary, subtype binary, format_type binary, format binary"
SUFFIX = "-Index.tmp"


def log_name(media: str) -> str:
    return media + SUFFIX


def header() -> bytes:
    return HEADER + struct.pack("<I", 1)


def pin_record(track: int, major: bytes, subtype: bytes, format_type: bytes = bytes(16), format: bytes = b"") -> bytes:
    return _PIN.pack(PIN, track, major, subtype, 0, 0, 0, format_type, 0, len(format), 0) + format


def sample_record(track: int, position: int, flags: int, size: int, start: int, length: int) -> bytes:
    return _SAMPLE.pack(SAMPLE, track, position, flags, size, start, length)


def records(data: Data) -> Iterator[tuple]:
    """Records in order, by their lengths: (SAMPLE, track, position, flags, size, start, length) or (PIN, track, major,
    subtype, kind of format, format). A torn or unknown record ends the log."""
    if data[:4] != HEADER:
        return
    at, whole = 8, len(data)
    while at + 4 <= whole:
        kind = data[at : at + 4]
        if kind == SAMPLE and at + _SAMPLE.size <= whole:
            yield _SAMPLE.unpack(data[at : at + _SAMPLE.size])
            at += _SAMPLE.size
        elif kind == PIN and at + _PIN.size <= whole:
            _, track, major, subtype, _, _, _, form, _, n, _ = _PIN.unpack(data[at : at + _PIN.size])
            at += _PIN.size
            if at + n > whole:
                return
            yield PIN, track, major, subtype, form, data[at : at + n]
            at += n
        else:
            return


def read_log(files: DataFrame) -> DataFrame:
    """Sample records of logs (path, content) or (path, length): LOG columns, track from the pin's index."""
    return _map(files, lambda p, c: [(p, i, *r[1:]) for i, r in enumerate(r for r in records(_whole(c)) if r[0] == SAMPLE)], LOG)


def read_pins(files: DataFrame) -> DataFrame:
    """Pin records of logs: PINS columns."""
    return _map(files, lambda p, c: [(p, *r[1:]) for r in records(_whole(c)) if r[0] == PIN], PINS)


def _whole(data: Data) -> bytes:
    return data[:]  # a log is a few bytes a sample


_DATA = LOG + ", data binary"


def payloads(log: DataFrame, files: DataFrame) -> DataFrame:
    """Log records with the bytes that they point at; records that reach beyond the end of the file go.

    Files are (path, length), read by ranges, or (path, content). A file is opened once a task, whole contents meet their
    records within a function and are never copied to them.
    """
    names = [f.split()[0] for f in LOG.split(", ")]
    log = log.select(*names, F.expr(f"substr(path, 1, length(path) - {len(SUFFIX)})").alias("media"))
    if "content" in files.columns:
        def cut(rows: pa.Table, media: pa.Table) -> pa.Table:
            if not media.num_rows:
                return rows.slice(0, 0).select(names).append_column("data", pa.array([], pa.binary()))
            return _cut(rows.select(names), media["content"][0].as_py())

        return log.groupBy("media").cogroup(files.select(F.col("path").alias("media"), "content").groupBy("media")).applyInArrow(cut, _DATA)

    # A file's records lie together, dealt over tasks by position.
    ranged = log.join(files.select(F.col("path").alias("media"), F.col("length").alias("whole")), "media").select(*names, "media", "whole")
    ranged = ranged.repartitionByRange("media", "position").sortWithinPartitions("media", "position")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, data = None, None
        for b in batches:
            media = b.column(len(names)).to_pylist()
            for i in range(0, b.num_rows, 64):  # so many payloads at a time
                part = pa.Table.from_batches([b.slice(i, 64)])
                for name in dict.fromkeys(media[i : i + 64]):
                    if name != path:
                        if data is not None:
                            data.close()
                        here = part.filter(pa.compute.equal(part["media"], name))
                        path, data = name, Ranged(name, here["whole"][0].as_py())
                    rows = part.filter(pa.compute.equal(part["media"], name)).select(names)
                    yield from _cut(rows, data).combine_chunks().to_batches()
        if data is not None:
            data.close()

    return ranged.mapInArrow(read, _DATA)


def _cut(rows: pa.Table, data: Data) -> pa.Table:
    at, size = rows["position"].to_pylist(), rows["size"].to_pylist()
    good = [a >= 0 and a + n <= len(data) for a, n in zip(at, size, strict=True)]
    kept = rows.filter(pa.array(good, pa.bool_()))
    return kept.append_column("data", pa.array([data[a : a + n] for a, n, ok in zip(at, size, good, strict=True) if ok], pa.binary()))


def recovered(found: DataFrame, codecs: DataFrame | None = None, start_codes: bool = False) -> DataFrame:
    """Payload rows as samples for the writer: (session, track, seq, start, stop, sync, preroll, discontinuity, codec, data).

    A time holds if its flag is set: a sample without start has none and is left out by the writer, one without stop ends
    at the next. ``codecs`` are (track, codec); tracks without one are raw. With ``start_codes`` payloads of AVC tracks, which
    lie in the file behind their lengths, come as the stream that the writer once took.
    """
    bit = lambda n: F.col("flags").bitwiseAND(n) != 0
    rows = found.select(
        F.expr(f"element_at(split(substr(path, 1, length(path) - {len(SUFFIX)}), '/'), -1)").alias("session"), "track", F.col("ordinal").alias("seq"),
        F.when(bit(TIME), F.col("start")).alias("start"), F.when(bit(TIME) & bit(STOP), F.col("start") + F.col("length")).alias("stop"),
        bit(SYNC).alias("sync"), bit(PREROLL).alias("preroll"), bit(DISCONTINUITY).alias("discontinuity"), "data",
    )
    named = rows.withColumn("codec", F.lit("raw ")) if codecs is None else rows.join(F.broadcast(codecs), "track", "left").withColumn("codec", F.coalesce("codec", F.lit("raw ")))
    if start_codes:
        named = named.withColumn("data", F.when(F.col("codec") == "avc1", start_code_column("data")).otherwise(F.col("data")))
    return named.select("session", "track", "seq", "start", "stop", "sync", "preroll", "discontinuity", "codec", "data")


def progress(log: DataFrame, every: int = 2048) -> DataFrame:
    """(path, ordinal, position, records): after every so many records how far a recovery has come, and the number of all."""
    ends = log.groupBy("path").agg(F.count("*").alias("records"))
    return log.where((F.col("ordinal") + 1) % every == 0).join(ends, "path").select("path", "ordinal", F.col("position") + F.col("size"), "records").toDF("path", "ordinal", "position", "records")


def replace_broken(made: str, broken: str) -> None:
    """Puts a recovered file in the place of the broken one, at once, and removes its index."""
    os.replace(made, broken)
    if os.path.exists(log_name(broken)):
        os.remove(log_name(broken))


class LogWriter:
    """Appends records to an index while a file is being written; they are on disk after every FLUSH records."""

    FLUSH = 1024

    def __init__(self, media: str):
        self.path, self.count = log_name(media), 0
        self.file = open(self.path, "wb")  # noqa: SIM115
        self.file.write(header())

    def pin(self, *fields, **named) -> None:
        self.file.write(pin_record(*fields, **named))

    def sample(self, *fields) -> None:
        self.file.write(sample_record(*fields))
        self.count += 1
        if self.count % self.FLUSH == 0:
            self.flush()

    def flush(self) -> None:
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self, finished: bool = True) -> None:
        """The index goes when the file is whole, and stays after a crash."""
        self.flush()
        self.file.close()
        if finished:
            os.remove(self.path)
