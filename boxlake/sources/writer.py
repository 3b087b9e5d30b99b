"""Writing ISO base media files: index tables from samples, boxes, one file a session.

A file is made as a table of its parts. Chunks are numbered and placed without their payloads; payloads are put together
chunk by chunk in parallel and no task holds a session's. A track's index is one task's work, the header takes the tracks'
finished boxes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.bits import compose_descriptor

UNITS, SCALE = 10_000_000, 360_000
#: A media box is closed when it holds this much; offsets from 2^31 on are written in 64 bits.
MEDIA_BYTES, NARROW = 1 << 30, 1 << 31


def box(kind: bytes, *parts: bytes) -> bytes:
    data = b"".join(parts)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def runs(values: Sequence[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [(n, v) for n, v in out]


@dataclass
class Track:
    """What the index needs of a track's samples, in the order in which they were written."""

    handler: str = "vide"
    codec: bytes = b"raw "
    width: int = 0
    height: int = 0
    rate: int = 48000
    channels: int = 2
    specific: bytes = b""
    described: bytes = b""  # a finished sample description, which goes before all others
    starts: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    sync: list[bool] = field(default_factory=list)
    chunks: list[tuple[int, int]] = field(default_factory=list)  # offset, samples

    def decode_times(self, align: int) -> tuple[list[int], list[int]]:
        """Deltas and composition offsets in ticks; offsets only if starts go back."""
        scaled = [(t - align) * SCALE // UNITS for t in self.starts]
        stops = [(t - align) * SCALE // UNITS for t in self.stops]
        if all(a <= b for a, b in zip(scaled, scaled[1:], strict=False)):
            return [max(1, b - a) for a, b in zip(scaled, [*scaled[1:], stops[-1]], strict=True)], []
        at, deltas, offsets, done = self.starts[0] - align, [], [], 0
        for i in range(len(scaled)):
            before, done = (at + done) * SCALE // UNITS, done + max(1, self.stops[i] - self.starts[i])
            deltas.append((at + done) * SCALE // UNITS - before)
            offsets.append(scaled[i] - before)
        return deltas, offsets

    def entry(self) -> bytes:
        """The sample description."""
        if self.described:
            return self.described
        head = bytes(6) + struct.pack(">H", 1)
        if self.handler == "vide":
            return box(self.codec, head, bytes(16), struct.pack(">HHIIIH", self.width, self.height, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 24, -1), box(b"avcC", self.specific) if self.codec == b"avc1" else b"")
        if self.handler == "soun":
            rate = 45000 if self.rate > 65535 else self.rate
            inner = b""
            if self.codec == b"mp4a":
                config = compose_descriptor(4, bytes([0x40, 0x15]) + bytes(11) + compose_descriptor(5, self.specific))
                inner = full(b"esds", compose_descriptor(3, bytes(3) + config + compose_descriptor(6, b"\2")))
            return box(self.codec, head, bytes(8), struct.pack(">HHII", self.channels, 16, 0, rate << 16), inner)
        return box(self.codec, head)

    def table(self, align: int) -> bytes:
        deltas, offsets = self.decode_times(align)
        pairs = lambda rows, code=">II": struct.pack(">I", len(rows)) + b"".join(struct.pack(code, *r) for r in rows)
        parts = [full(b"stsd", struct.pack(">I", 1), self.entry()), full(b"stts", pairs(runs(deltas)))]
        if offsets:
            parts.append(full(b"ctts", pairs(runs(offsets), ">Ii"), version=1 if min(offsets) < 0 else 0))
        points, last = [], None
        for i, (_, n) in enumerate(self.chunks):
            if n != last:
                points.append((i + 1, n, 1))
                last = n
        parts.append(full(b"stsc", pairs(points, ">III")))
        fixed = self.sizes[0] if len(set(self.sizes)) == 1 else 0
        parts.append(full(b"stsz", struct.pack(">II", fixed, len(self.sizes)), b"" if fixed else struct.pack(f">{len(self.sizes)}I", *self.sizes)))
        wide = any(o >= NARROW for o, _ in self.chunks)
        parts.append(full(b"co64" if wide else b"stco", struct.pack(f">I{len(self.chunks)}{'Q' if wide else 'I'}", len(self.chunks), *(o for o, _ in self.chunks))))
        if not all(self.sync):
            keys = [i + 1 for i, s in enumerate(self.sync) if s]
            parts.append(full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)))
        return box(b"stbl", *parts)

    def trak(self, number: int, align: int) -> bytes:
        first, end = min(self.starts) - align, max(self.stops) - align
        length, head = end * SCALE // UNITS, {"vide": full(b"vmhd", bytes(8), flags=1), "soun": full(b"smhd", bytes(4))}.get(self.handler, full(b"nmhd"))
        edits = box(b"edts", full(b"elst", struct.pack(">IIiIIiI", 2, first * SCALE // UNITS, -1, 1 << 16, (end - first) * SCALE // UNITS, 0, 1 << 16))) if first > 0 else b""
        return box(
            b"trak",
            full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, length & 0xFFFFFFFF), bytes(8), struct.pack(">HHHH", 0, 0, 256 if self.handler == "soun" else 0, 0), _MATRIX, struct.pack(">II", self.width << 16, self.height << 16), flags=3),
            edits,
            box(
                b"mdia",
                full(b"mdhd", struct.pack(">QQIQHH", 0, 0, SCALE, length, 0x55C4, 0), version=1),
                full(b"hdlr", bytes(4), self.handler.encode(), bytes(13)),
                box(b"minf", head, box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), self.table(min(self.starts))),
            ),
        )


_MATRIX = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def movie_box(tracks: Sequence[Track], comment: str | None = None, attributes: Sequence[tuple[str, str]] = (), align: bool = True, minimal_duration: int = 0) -> bytes:
    tracks = [t for t in tracks if t.starts]
    base = min((min(t.starts) for t in tracks), default=0) if align else 0
    length = max([0, *(max(t.stops) - base for t in tracks)])
    made = [(i + 1, t.handler, t.trak(i + 1, base)) for i, t in enumerate(tracks)]
    return movie_header(made, max(length, minimal_duration) * SCALE // UNITS, comment, attributes)


def object_list(numbers: Sequence[int]) -> bytes:
    """The initial object descriptor, which lists sound and picture tracks."""
    listed = b"".join(compose_descriptor(14, struct.pack(">I", n)) for n in numbers)
    return full(b"iods", compose_descriptor(16, bytes([0, 0x4F, 0xFF, 0xFF, 0x0F, 0x03, 0xFF]) + listed))


def movie_header(tracks: Sequence[tuple[int, str, bytes]], length: int, comment: str | None = None, attributes: Sequence[tuple[str, str]] = ()) -> bytes:
    """The movie box of finished track boxes (number, handler, box) and a length in ticks."""
    data = user_data(comment, attributes)
    head = full(b"mvhd", struct.pack(">QQIQIHH", 0, 0, SCALE, length, 1 << 16, 256, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", len(tracks) + 1), version=1)
    objects = object_list([n for n, handler, _ in tracks if handler in ("vide", "soun")])
    return box(b"moov", head, objects, *(t for _, _, t in tracks), box(b"udta", *data) if data else b"")


def user_data(comment: str | None, attributes: Sequence[tuple[str, str]]) -> list[bytes]:
    """The boxes of a comment and of named strings."""
    data = []
    if comment is not None:
        data.append(full(b"meta", box(b"ilst", box(b"\xa9cmt", box(b"data", struct.pack(">II", 1, 0), comment.encode())))))
    if attributes:
        records = []
        for name, value in attributes:
            n, v = name.encode("latin-1"), (value + "\0").encode("utf-16-le")
            records.append(struct.pack(">II", 18 + len(n) + len(v), len(n)) + n + struct.pack(">IIH", 1, 6 + len(v), 8) + v)
        data.append(box(b"Xtra", *records))
    return data


#: Codes whose files have the brand of the standard, and codes of sound.
STANDARD, SOUND = ("avc1", "mp4a", "mp4v", "ac-3", "ec-3"), ("mp4a", "sowt", "twos", "in24", "in32", "lpcm", "alaw", "ulaw", "ac-3", "ec-3", ".mp3")
_FIRST = 20  # bytes of the type box
_LAST = 1 << 62


def numbered(rows: DataFrame, chunk_bytes: int, chunk_time: int) -> DataFrame:
    """Rows (session, track, seq, start, stop, sync, size) with their chunk, which is closed by bytes or time."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, held, first, end = None, 0, None, 0, 0
        for b in batches:
            out = []
            for session, track, start, stop, size in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 6)), strict=True):
                if (session, track) != key:
                    key, chunk, held = (session, track), 0, None
                if held is None:
                    held, first, end = 0, start, stop
                out.append(chunk)
                held, first, end = held + size, min(first, start), max(end, stop)
                if held > chunk_bytes or end - first > chunk_time:
                    chunk, held = chunk + 1, None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "chunk"])

    dealt = rows.select("session", "track", "seq", "start", "stop", "sync", "size").repartition("session", "track").sortWithinPartitions("session", "track", "seq")
    return dealt.mapInArrow(number, "session string, track int, seq long, start long, stop long, sync boolean, size long, chunk long")


def placed(chunks: DataFrame, media_bytes: int = MEDIA_BYTES) -> DataFrame:
    """(session, part, track, chunk, offset, head) of chunks (session, track, chunk, t_start, bytes) in write order.

    Media boxes are closed when they hold ``media_bytes``; their heads are rows of their own (track and chunk null).
    """
    queue = Window.partitionBy("session", "track").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    order = ["session", "merge_t", "track", "chunk"]
    rows = chunks.withColumn("merge_t", F.max("t_start").over(queue)).select(*order, "bytes").repartition("session").sortWithinPartitions(*order)
    schema = pa.schema([("session", pa.string()), ("part", pa.int64()), ("track", pa.int32()), ("chunk", pa.int64()), ("offset", pa.int64()), ("head", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, at, part, opened, size = None, _FIRST, 1, None, 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()
            return made

        for b in batches:
            for s, _, track, chunk, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != session:
                    if opened is not None:
                        out.append((session, opened, None, None, at, struct.pack(">I4s", size + 8, b"mdat")))
                    session, at, part, opened, size = s, _FIRST, 1, None, 0
                if opened is None:
                    opened, part = part, part + 1
                out.append((s, part, track, chunk, at + 8 + size, None))
                part, size = part + 1, size + n
                if size >= media_bytes:
                    out.append((s, opened, None, None, at, struct.pack(">I4s", size + 8, b"mdat")))
                    at, opened, size = at + 8 + size, None, 0
            yield batch()
        if opened is not None:
            out.append((session, opened, None, None, at, struct.pack(">I4s", size + 8, b"mdat")))
        yield batch()

    return rows.mapInArrow(place, "session string, part long, track int, chunk long, offset long, head binary")


def encode_parts(samples: DataFrame, chunk_bytes: int = 400 << 10, chunk_time: int = UNITS, media_bytes: int = MEDIA_BYTES, comment: str | None = None, attributes: Sequence[tuple[str, str]] = (), align: bool = True, minimal_duration: int = 0, entries: DataFrame | None = None) -> DataFrame:
    """(session, part long, content binary): the parts of a file of each session, which in order of ``part`` are the file.

    Samples are (session string, track int, seq long, start, stop, sync, codec string, data binary), (session, track, seq)
    unique. A missing stop is a start and 1, a missing payload is empty, a missing sync is none; rows without session,
    track, seq or start have no place and are left out. Chunks are written earliest head first, a track's in order.
    ``entries`` are sample descriptions (see entries.py), one a track at most; tracks without one are described by their code.
    """
    whole = samples.dropna(subset=["session", "track", "seq", "start"])
    rows = whole.select("session", F.col("track").cast("int"), F.col("seq").cast("long"), F.col("start").cast("long"), F.coalesce("stop", F.col("start") + 1).cast("long").alias("stop"), F.coalesce("sync", F.lit(False)).alias("sync"), "codec", F.coalesce("data", F.unhex(F.lit(""))).alias("data"))
    index = numbered(rows.withColumn("size", F.octet_length("data").cast("long")), chunk_bytes, chunk_time)
    places = placed(index.groupBy("session", "track", "chunk").agg(F.min("start").alias("t_start"), F.sum("size").alias("bytes")), media_bytes)
    own = Window.partitionBy("session")
    tracks = rows.groupBy("session", "track").agg(F.min("start").alias("first"), F.max("stop").alias("end"), F.coalesce(F.min_by("codec", "seq"), F.lit("raw ")).alias("codec"))
    base = F.min("first").over(own) if align else F.lit(0).cast("long")
    tracks = tracks.select("session", "track", "codec", "end", F.row_number().over(own.orderBy("track")).alias("number"), base.alias("base"))

    def trak(samples_: pa.Table, chunks: pa.Table) -> pa.Table:
        schema = pa.schema([("session", pa.string()), ("number", pa.int32()), ("handler", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        if not samples_.num_rows:
            return schema.empty_table()
        t = samples_.sort_by("seq")
        head = {n: t[n][0].as_py() for n in ("session", "codec", "number", "base", "end")}
        made = Track("soun" if head["codec"] in SOUND else "vide", head["codec"].encode("latin-1"))
        if "entry" in chunks.column_names and (own := [r for r in chunks.select(["media", "width", "height", "entry"]).slice(0, 1).to_pylist() if r["entry"]]):
            made.handler, made.width, made.height, made.described = own[0]["media"], own[0]["width"], own[0]["height"], own[0]["entry"]
        made.starts, made.stops, made.sizes, made.sync = (t[n].to_pylist() for n in ("start", "stop", "size", "sync"))
        counts = t.group_by("chunk").aggregate([("seq", "count")])
        counts = dict(zip(counts["chunk"].to_pylist(), counts["seq_count"].to_pylist(), strict=True))
        chunks = chunks.sort_by("chunk")
        made.chunks = [(o, counts[c]) for c, o in zip(chunks["chunk"].to_pylist(), chunks["offset"].to_pylist(), strict=True)]
        data = made.trak(head["number"], head["base"])
        return pa.Table.from_pylist([{"session": head["session"], "number": head["number"], "handler": made.handler, "length": head["end"] - head["base"], "content": data}], schema)

    def header(table: pa.Table) -> pa.Table:
        made = sorted((r["number"], r["handler"], r["content"]) for r in table.to_pylist())
        length = max([minimal_duration, *table["length"].to_pylist()]) * SCALE // UNITS
        return pa.table({"session": table["session"][:1], "part": pa.array([_LAST], pa.int64()), "content": pa.array([movie_header(made, length, comment, attributes)], pa.binary())})

    chunks = places.where("head is null").select("session", "track", "chunk", "offset", "part")
    known = chunks if entries is None else chunks.join(entries, ["session", "track"], "left")  # a few bytes beside a chunk's many
    boxes = index.join(tracks, ["session", "track"]).groupBy("session", "track").cogroup(known.groupBy("session", "track")).applyInArrow(trak, "session string, number int, handler string, length long, content binary")
    movies = boxes.groupBy("session").applyInArrow(header, "session string, part long, content binary")
    brand = F.when(F.bool_and(F.col("codec").isin(*STANDARD)), F.lit(box(b"ftyp", b"mp42", bytes(4), b"mp42"))).otherwise(F.lit(box(b"ftyp", b"qt  ", bytes(4), b"qt  ")))
    first = tracks.groupBy("session").agg(brand.alias("content")).select("session", F.lit(0).cast("long").alias("part"), "content")
    payload = rows.select("session", "track", "seq", "data").join(index.select("session", "track", "seq", "chunk"), ["session", "track", "seq"])
    media = payload.groupBy("session", "track", "chunk").agg(F.expr("listagg(data) within group (order by seq)").alias("content")).join(chunks, ["session", "track", "chunk"]).select("session", "part", "content")
    return first.unionByName(places.where("head is not null").select("session", "part", F.col("head").alias("content"))).unionByName(media).unionByName(movies)


def encode_sessions(samples: DataFrame, chunk_bytes: int = 400 << 10, chunk_time: int = UNITS, **options) -> DataFrame:
    """(session, content binary): whole files as values, so of less than 2 GB; larger ones go through ``write_files``."""
    return encode_parts(samples, chunk_bytes, chunk_time, **options).groupBy("session").agg(F.expr("listagg(content) within group (order by part)").alias("content"))


def write_files(parts: DataFrame, folder: str, suffix: str = ".mp4", combine: int = 1 << 20, preallocate: int = 0) -> DataFrame:
    """Writes each session's parts to ``folder/session`` and returns (session, path, bytes). Lazy: an action writes.

    Parts are combined until ``combine`` bytes are there to write. With ``preallocate`` a file has that length from the start;
    what its parts (``bytes``) leave of it becomes a free box, or is cut off if it is too short or too long (2 GB) for one.

    The folder has to be one that all executors see. A task streams parts in order to a name of its attempt and renames it
    when the file is whole, so a lost or repeated task leaves no half file under the final name.
    """
    rows = parts.select("session", "part", "content").repartition("session").sortWithinPartitions("session", "part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        session, out, size = None, None, 0
        context = TaskContext.get()
        mark = f".part-{context.partitionId()}-{context.taskAttemptId()}" if context else ".part"

        def finish() -> pa.RecordBatch:
            rest = preallocate - size
            if 8 <= rest < NARROW - 1:
                out.write(struct.pack(">I4s", rest, b"free"))
            elif rest > 0:
                out.truncate(size)
            out.close()
            path = out.name.removesuffix(mark)
            os.replace(out.name, path)
            return pa.RecordBatch.from_pydict({"session": [session], "path": [path], "bytes": pa.array([size], pa.int64())})

        for b in batches:
            for s, content in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if s != session:
                    if out:
                        yield finish()
                    if os.path.basename(s) != s or s in ("", ".", ".."):
                        raise ValueError(f"session {s!r} is no file name")
                    session, size = s, 0
                    out = open(os.path.join(folder, s + suffix + mark), "wb", buffering=max(2, combine))  # noqa: SIM115
                    out.truncate(preallocate)
                size += out.write(content.as_buffer())
        if out:
            yield finish()

    return rows.mapInArrow(write, "session string, path string, bytes long")
