"""Change of the comment and the attributes of files that exist.

Media bytes and chunk offsets stay where they are: a new movie box goes to the end of the file and the old one becomes free
space. Only the movie box is read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame

from boxlake.sources.boxes import Box, Data, Ranged, _map, movie, walk
from boxlake.sources.writer import box, user_data

PATCHES = "path string, step int, position long, data binary"
JOURNAL = "-Change.tmp"


def _whole(b: Box, data: Data) -> bytes:
    """A box with its length stated, also if it went to the end of its parent."""
    raw = data[b.offset : b.offset + b.length]
    return raw if raw[:4] != bytes(4) else struct.pack(">I", b.length) + raw[4:]


def new_movie(data: Data, moov: Box, comment: str | None, attributes: Sequence[tuple[str, str]] | None) -> bytes:
    """The movie box with another comment or other attributes; None keeps what is there."""
    changed = {kind for kind, x in ((b"meta", comment), (b"Xtra", attributes)) if x is not None}
    user = moov.find(b"udta")
    kept = [_whole(c, data) for c in user.children if c.kind not in changed] if user else []
    kept += user_data(comment, attributes or ())
    return box(b"moov", *(_whole(c, data) for c in moov.children if c.kind != b"udta"), box(b"udta", *kept) if kept else b"")


def patches(data: Data, comment: str | None = None, attributes: Sequence[tuple[str, str]] | None = None) -> list[tuple[int, bytes]]:
    """What to write where, in this order. Nothing if all is so already, and for files without a movie or with boxes that
    don't fit; an open last box is closed if its length fits 32 bits, else the file can't be changed (ValueError)."""
    top = walk(data).children
    moov = next((b for b in top if b.kind == b"moov"), None)
    known = movie(data) if moov else None
    if known is None or top[-1].offset + top[-1].length != len(data):
        return []
    if comment in (None, known["comment"]) and (attributes is None or list(map(tuple, attributes)) == known["attributes"]):
        return []
    out, last = [], top[-1]
    if data[last.offset : last.offset + 4] == bytes(4):
        if last.length >= 1 << 32:
            raise ValueError("the last box is open and too long for a length of 32 bits")
        out.append((last.offset, struct.pack(">I", last.length)))
    return [*out, (len(data), new_movie(data, moov, comment, attributes)), (moov.offset + 4, b"free")]


def metadata_patches(files: DataFrame, comment: str | None = None, attributes: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(path, step, position, data) of files (path, content) or (path, length): see patches()."""
    return _map(files, lambda path, data: [(path, i, *p) for i, p in enumerate(patches(data, comment, attributes))], PATCHES)


def patched(data: bytes, changes: Sequence[tuple[int, bytes]]) -> bytes:
    out = bytearray(data)
    for at, new in changes:
        out[at : at + len(new)] = new
    return bytes(out)


def changed_contents(files: DataFrame, comment: str | None = None, attributes: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(path, content) of files (path, content) after the change."""
    return _map(files, lambda path, data: [(path, patched(data, patches(data, comment, attributes)))], "path string, content binary")


def change_file(path: str, comment: str | None = None, attributes: Sequence[tuple[str, str]] | None = None) -> int:
    """Changes a file in place and returns its new length. The old movie is valid until the new one is on disk whole; a
    journal beside the file has its old length, so that a repeated call first takes back what a lost one left."""
    journal = path + JOURNAL
    if os.path.exists(journal):
        with open(journal) as j:
            before = j.read()
        if before.endswith("\n"):  # written whole
            os.truncate(path, int(before))
        os.remove(journal)
    data = Ranged(path, os.path.getsize(path))
    try:
        changes = patches(data, comment, attributes)
        if not changes:
            return len(data)
        with open(journal, "w") as j:
            j.write(f"{len(data)}\n")
            j.flush()
            os.fsync(j.fileno())
        with open(path, "r+b") as f:
            for at, new in changes[:-1]:
                f.seek(at)
                f.write(new)
            f.flush()
            os.fsync(f.fileno())
            os.remove(journal)
            at, new = changes[-1]
            f.seek(at)
            f.write(new)
    finally:
        data.close()
    return os.path.getsize(path)


def change_files(files: DataFrame, comment: str | None = None, attributes: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(path, bytes) of files (path, ...), changed in place. Lazy: an action changes. Paths are of a folder that all executors
    see; a file is changed by one task, and a repeated task changes nothing more."""

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [(p, change_file(unquote(urlparse(p).path) if p.startswith("file:") else p, comment, attributes)) for p in b["path"]]
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return files.select("path").distinct().mapInPandas(change, "path string, bytes long")
