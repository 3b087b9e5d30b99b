"""Motion JPEG pictures of two fields: markers that readers need, with sizes and offsets counted from the finished layout."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, SparkSession

from boxlake.functions.bits import column

#: Markers, tags of the two application segments, kinds and places of the standard tables.
SOI, EOI, SOF, DHT, DQT, SOS, APP0, APP1 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDA, 0xE0, 0xE1
AVI, FIELDS = b"AVI1", b"mjpg"
TABLES = (("StdDCLuminance", 0x00), ("StdACLuminance", 0x10), ("StdDCChrominance", 0x01), ("StdACChrominance", 0x11))
#: A marker that isn't stuffing, filling or a restart.
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.DOTALL)
_AVI = struct.Struct(">HH4sBBII")  # marker, length, tag, polarity, 0, padded size, size
_OFFSETS = struct.Struct(">HHI4s8I")  # marker, length, 0, tag, size, padded size, next, tables (2), frame, scan, data


@dataclass
class Field:
    pieces: list[tuple[int, bytes]]  # marker, segment with what follows it up to the next
    padding: bytes

    def has(self, kind: int, tag: bytes = b"", at: int = 0) -> bool:
        return any(k == kind and p[at : at + len(tag)] == tag for k, p in self.pieces)

    def whole(self) -> bool:
        return self.has(APP0, AVI, 4) and self.has(APP1, FIELDS, 8) and self.has(DHT)


def fields(data: bytes) -> list[Field] | None:
    """The fields of a picture; None if it doesn't begin with one or a segment is cut short. A field without an end goes up
    to the next or to the end of the data; what lies between an end and the next start is padding."""
    out, at = [], 0
    if data[:2] != b"\xff\xd8":
        return None
    while at < len(data):
        marks, at = [], at + 2
        while True:
            m = _MARKER.search(data, at)
            kind = data[m.end() - 1] if m else SOI
            if kind in (SOI, EOI):
                break
            size = int.from_bytes(data[m.start() + 2 : m.start() + 4], "big")
            if size < 2 or m.start() + 2 + size > len(data):
                return None
            marks.append((kind, m.start()))
            at = m.start() + 2 + size
        end = len(data) if m is None else m.end() if kind == EOI else m.start()
        bounds = [a for _, a in marks] + [end]
        then = data.find(b"\xff\xd8", end)
        at = len(data) if then < 0 else then
        out.append(Field([(k, data[a:z]) for (k, a), z in zip(marks, bounds[1:], strict=True)], data[end:at]))
    return out


def _composed(field: Field, last: bool, tables: bytes) -> bytes:
    """A field with both application segments and tables; SOI and other first segments of the kind stay ahead."""
    known = next((p for k, p in field.pieces if k == APP0 and p[4:8] == AVI), b"")
    ahead = [p for k, p in field.pieces if k == APP0 and p[4:8] != AVI]
    body = [(k, p) for k, p in field.pieces if k != APP0 and not (k == APP1 and p[8:12] == FIELDS)]
    if not field.has(DHT):
        body.insert(0, (DHT, tables))
    at = 2 + sum(map(len, ahead)) + _AVI.size + _OFFSETS.size
    where: dict[int, int] = {}
    after = 0
    for kind, piece in body:
        if kind == SOS and SOS not in where:
            after = at + 2 + int.from_bytes(piece[2:4], "big")
        where.setdefault(kind, at)
        at += len(piece)
    padded = at + len(field.padding)
    polarity = known[8] if len(known) > 8 else 1
    avi = _AVI.pack(0xFF00 | APP0, _AVI.size - 2, AVI, polarity, 0, padded, at)
    offsets = _OFFSETS.pack(0xFF00 | APP1, _OFFSETS.size - 2, 0, FIELDS, at, padded, 0 if last else padded, *(where.get(k, 0) for k in (DQT, DHT, SOF, SOS)), after)
    return b"\xff\xd8" + b"".join(ahead) + avi + offsets + b"".join(p for _, p in body) + field.padding


def repaired(data: bytes, tables: bytes | None = None) -> dict | None:
    """``kind`` and ``data`` of a picture for the writer; None if it is no picture, or lacks tables and none are given.

    A picture of one field is a ``jpeg`` and stays as it is, so do pictures (``mjpa``) whose fields have all markers. In
    others each field gets what it lacks.
    """
    found = fields(data)
    if found is None:
        return None
    if len(found) == 1:
        return {"kind": "jpeg", "data": data}
    if not all(f.whole() for f in found):
        if tables is None and not all(f.has(DHT) for f in found):
            return None
        data = b"".join(_composed(f, i == len(found) - 1, tables or b"") for i, f in enumerate(found))
    return {"kind": "mjpa", "data": data}


def standard_tables(spark: SparkSession) -> bytes:
    """A segment of the standard's example tables, which pictures without tables mean; they come from Java's own library."""
    known = spark._jvm.javax.imageio.plugins.jpeg.JPEGHuffmanTable
    made = b""
    for name, place in TABLES:
        table = getattr(known, name)
        made += bytes([place]) + bytes(table.getLengths()).ljust(16, b"\0") + bytes(table.getValues())
    return struct.pack(">HH", 0xFF00 | DHT, len(made) + 2) + made


def repaired_column(tables: bytes | None = None) -> Callable[[Column | str], Column]:
    return column(partial(repaired, tables=tables), "struct<kind:string,data:binary>")
