"""ISO base media files as tables.

Files are listed by Spark's ``binaryFile`` source, by path and length (``listed``), and read by ranges: the heads of
boxes, and of the movie box all. A file of any size costs what its header costs. ``files`` has whole contents beside the
paths, for small files and for stores that only Spark opens; every operator here takes both forms. Media payloads stay
out of the tables.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTAINERS = frozenset({b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"ilst", b"\xa9cmt", b"cctk"})


class Ranged:
    """The bytes of a file as slices that are read when they are asked for. What hold() has read is not read again."""

    def __init__(self, path: str, length: int):
        from pyarrow import fs

        local = urlparse(path).scheme in ("", "file")
        system, name = (fs.LocalFileSystem(), unquote(urlparse(path).path) if path.startswith("file:") else path) if local else fs.FileSystem.from_uri(path)
        self.file, self.length, self.held, self.at = system.open_input_file(name), length, b"", 0

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, part: slice) -> bytes:
        a, z, _ = part.indices(self.length)
        if self.at <= a and z <= self.at + len(self.held):
            return self.held[a - self.at : z - self.at]
        return self.file.read_at(max(0, z - a), a)

    def hold(self, at: int, n: int) -> None:
        self.held, self.at = self[at : at + n], at

    def close(self) -> None:
        self.file.close()


Data = bytes | Ranged


@dataclass
class Box:
    id: int
    parent: int
    depth: int
    ordinal: int
    kind: bytes
    offset: int
    length: int
    header: int
    children: list[Box] = field(default_factory=list)

    def payload(self, data: Data) -> bytes:
        return data[self.offset + self.header : self.offset + self.length]

    def find(self, *path: bytes) -> Box | None:
        """The first child of a type, and so on down."""
        for kind in path:
            self = next((c for c in self.children if c.kind == kind), None)
            if self is None:
                return None
        return self


def walk(data: Data) -> Box:
    """The tree of boxes; a length beyond the parent ends the scan of that parent, length 0 reaches its end."""
    root = Box(0, -1, 0, 0, b"", 0, len(data), 0)
    count = 0

    def scan(parent: Box, at: int, end: int) -> None:
        nonlocal count
        ordinal = 0
        while at + 8 <= end:
            head = data[at : at + 16]
            size, kind = struct.unpack_from(">I4s", head)
            header = 8
            if size == 1 and at + 16 <= end:
                size, header = struct.unpack_from(">q", head, 8)[0], 16
            elif size == 0:
                size = end - at
            header += 16 * (kind == b"uuid")
            if size < header or at + size > end:
                break
            count += 1
            box = Box(count, parent.id, parent.depth + 1, ordinal, kind, at, size, header)
            parent.children.append(box)
            if kind in CONTAINERS or kind == b"meta":
                if kind == b"moov" and isinstance(data, Ranged):
                    data.hold(at, size)
                scan(box, at + header + 4 * (kind == b"meta"), at + size)
            at, ordinal = at + size, ordinal + 1

    scan(root, 0, len(data))
    return root


def flat(box: Box) -> Iterator[Box]:
    for c in box.children:
        yield c
        yield from flat(c)


def _pairs(data: bytes, signed: bool = False) -> list[tuple[int, int]]:
    n = struct.unpack_from(">I", data, 4)[0]
    return [struct.unpack_from(">Ii" if signed else ">II", data, 8 + 8 * i) for i in range(min(n, (len(data) - 8) // 8))]


def _numbers(data: bytes, code: str, at: int = 8, count: int | None = None) -> list[int]:
    size = struct.calcsize(code)
    n = struct.unpack_from(">I", data, 4)[0] if count is None else count
    n = max(0, min(n, (len(data) - at) // size))
    return list(struct.unpack_from(f">{n}{code}", data, at))


def movie(data: Data, compat_edits: bool = False) -> dict | None:
    """Header, metadata and tracks with their run tables, or None without a movie."""
    root = walk(data)
    moov = root.find(b"moov")
    head = moov and moov.find(b"mvhd")
    if not head:
        return None
    p = head.payload(data)
    scale, duration = struct.unpack_from(">Iq", p, 20) if p[0] == 1 else struct.unpack_from(">II", p, 12)
    note = moov.find(b"udta", b"meta", b"ilst", b"\xa9cmt", b"data")
    extra = moov.find(b"udta", b"Xtra")
    tracks = [track(t, data, i, scale, compat_edits) for i, t in enumerate(c for c in moov.children if c.kind in (b"trak", b"cctk"))]
    return {"timescale": scale, "duration": duration, "comment": note.payload(data)[8:].decode("utf-8", "replace") if note else None, "attributes": attributes(extra.payload(data)) if extra else [], "tracks": tracks}


def attributes(data: bytes) -> list[tuple[str, str]]:
    """Named strings of a list of records (size, name, one value); a broken record ends the list."""
    out, at = [], 0
    try:
        while at + 8 <= len(data):
            size, n = struct.unpack_from(">II", data, at)
            name = data[at + 8 : at + 8 + n].decode("latin-1")
            count, length = struct.unpack_from(">II", data, at + 8 + n)
            kind = struct.unpack_from(">H", data, at + 16 + n)[0]
            if size < 18 + n or at + size > len(data) or length < 6:
                break
            if count == 1 and kind == 8:
                out.append((name, data[at + 18 + n : at + 12 + n + length].decode("utf-16-le").removesuffix("\0")))
            at += size
    except (struct.error, UnicodeDecodeError):
        pass
    return out


def track(box: Box, data: Data, number: int, movie_scale: int, compat_edits: bool) -> dict:
    """One track; ``valid`` if it is enabled, has its tables, one sample description and at least one sample."""
    out = {"track": number, "enabled": False, "valid": False, "timescale": None, "handler": None, "codec": None, "all_sync": True, "fixed_size": 0, "sample_count": 0, "stts": [], "ctts": [], "stsc": [], "chunk_offsets": [], "sizes": [], "sync": [], "edits": [], "entry": None}
    head = box.find(b"tkhd")
    out["enabled"] = bool(head and head.payload(data)[3] & 1)
    elst = box.find(b"edts", b"elst")
    if elst:
        p = elst.payload(data)
        n, code = struct.unpack_from(">I", p, 4)[0], ">qqI" if p[0] == 1 else ">IiI"
        size = struct.calcsize(code)
        for i in range(min(n, (len(p) - 8) // size)):
            length, media, _ = struct.unpack_from(code, p, 8 + size * i)
            out["edits"].append((length * 10_000_000 // movie_scale if movie_scale else 0, -1 if compat_edits and media == 0xFFFF else media))
    head, stbl, kind = box.find(b"mdia", b"mdhd"), box.find(b"mdia", b"minf", b"stbl"), box.find(b"mdia", b"hdlr")
    if not head or not stbl:
        return out
    p = head.payload(data)
    out["timescale"] = struct.unpack_from(">I", p, 20 if p[0] == 1 else 12)[0]
    out["handler"] = kind.payload(data)[8:12].decode("latin-1") if kind else None
    table = {c.kind: c.payload(data) for c in reversed(stbl.children)}
    described = table.get(b"stsd", b"")
    one = len(described) >= 16 and described[0] == 0 and struct.unpack_from(">I", described, 4)[0] == 1
    if one:
        out["codec"], out["entry"] = described[12:16].decode("latin-1"), described[16 : 8 + struct.unpack_from(">I", described, 8)[0]]
    if b"stsz" in table and len(table[b"stsz"]) >= 12 and table[b"stsz"][0] == 0:
        out["fixed_size"], out["sample_count"] = struct.unpack_from(">II", table[b"stsz"], 4)
        out["sizes"] = [] if out["fixed_size"] else _numbers(table[b"stsz"], "I", 12, out["sample_count"])
    out["stts"], out["ctts"] = _pairs(table[b"stts"]) if b"stts" in table else [], _pairs(table[b"ctts"], table[b"ctts"][0] == 1) if b"ctts" in table else []
    if b"stsc" in table:
        n = _numbers(table[b"stsc"], "I", 8, 3 * struct.unpack_from(">I", table[b"stsc"], 4)[0])
        out["stsc"] = list(zip(n[::3], n[1::3], strict=False))
    out["chunk_offsets"] = _numbers(table[b"stco"], "I") if b"stco" in table else _numbers(table[b"co64"], "Q") if b"co64" in table else []
    out["sync"] = _numbers(table[b"stss"], "I") if b"stss" in table and table[b"stss"][0] == 0 else []
    out["all_sync"] = not out["sync"]
    out["valid"] = bool(out["enabled"] and one and out["sample_count"] and out["stts"] and out["timescale"])
    return out


# ---------------------------------------------------------------- tables

BOXES = "path string, box_id int, parent_id int, depth int, ordinal int, fourcc binary, type string, offset long, length long, header_len int"
RUN = "array<struct<n:long,v:long>>"
TRACKS = f"path string, track int, enabled boolean, valid boolean, timescale long, handler string, codec string, all_sync boolean, fixed_size long, sample_count long, stts {RUN}, ctts {RUN}, stsc array<struct<first_chunk:long,spc:long>>, chunk_offsets array<long>, sizes array<long>, sync array<long>, edits array<struct<seg_dur:long,media_time:long>>, entry binary"
MOVIES = "path string, timescale long, duration long, comment string, attributes array<struct<name:string,value:string>>, tracks int, invalid_tracks int"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files: nothing of them is read yet."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole files as values, so of less than 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def opened(df: DataFrame) -> tuple[DataFrame, str]:
    """The columns that a task opens files by: (path, content) or (path, length)."""
    by = "content" if "content" in df.columns else "length"
    return df.select("path", by), by


def _map(df: DataFrame, rows, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    df, by = opened(df)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, x in zip(b["path"], b[by], strict=True):  # one file at a time
                data = bytes(x) if by == "content" else Ranged(path, x)
                yield pd.DataFrame(list(rows(path, data)), columns=names)
                if by == "length":
                    data.close()

    return df.mapInPandas(run, schema)


def boxes(df: DataFrame) -> DataFrame:
    """All boxes of files (path, content) or (path, length)."""
    return _map(df, lambda p, c: [(p, b.id, b.parent, b.depth, b.ordinal, b.kind, b.kind.decode("latin-1"), b.offset, b.length, b.header) for b in flat(walk(c))], BOXES)


def tracks(df: DataFrame) -> DataFrame:
    def rows(path: str, content: Data) -> list[tuple]:
        def named(x: list, a: str, b: str) -> list[dict]:
            return [{a: int(p), b: int(q)} for p, q in x]

        m = movie(content)
        return [(path, t["track"], t["enabled"], t["valid"], t["timescale"], t["handler"], t["codec"], t["all_sync"], t["fixed_size"], t["sample_count"], named(t["stts"], "n", "v"), named(t["ctts"], "n", "v"), named(t["stsc"], "first_chunk", "spc"), t["chunk_offsets"], t["sizes"], t["sync"], named(t["edits"], "seg_dur", "media_time"), t["entry"]) for t in (m["tracks"] if m else [])]

    return _map(df, rows, TRACKS)


def movies(df: DataFrame) -> DataFrame:
    def rows(path: str, content: Data) -> list[tuple]:
        m = movie(content)
        return [(path, m["timescale"], m["duration"], m["comment"], [{"name": a, "value": b} for a, b in m["attributes"]], len(m["tracks"]), sum(not t["valid"] for t in m["tracks"]))] if m else []

    return _map(df, rows, MOVIES)


def exploded(t: DataFrame, column: str, position: str, *fields: str) -> DataFrame:
    """One of the tracks' tables as rows: (path, track, position from 0, fields)."""
    rows = t.select("path", "track", F.posexplode(column).alias(position, "_x"))
    return rows.select("path", "track", position, *[F.col(f"_x.{f}").alias(f) for f in fields] if len(fields) > 1 else [F.col("_x").alias(fields[0])])


def recovery_needed(df: DataFrame) -> DataFrame:
    """(path, needed) of files (path, content) or (path, length): no movie, an open media box, or boxes that don't fit."""

    def rows(path: str, content: Data) -> list[tuple]:
        top = walk(content).children
        whole = bool(top) and top[-1].offset + top[-1].length == len(content)
        return [(path, not whole or all(b.kind != b"moov" for b in top) or any(b.kind == b"mdat" and b.length == 8 for b in top))]

    return _map(df, rows, "path string, needed boolean")
