"""Secret scans: fixed patterns, and novelty against a zstandard dictionary.

The patterns give the base spans. Beyond them, a string in a sensitive context is measured by its marginal compressed
bytes: what it adds to its surroundings when both are compressed with a dictionary of identifiers and code. Words, paths
and names that the surroundings or the dictionary hold add little; keys and passwords add nearly their length. A string's
other occurrences are not among its surroundings, and all of them are reported once one is found in a sensitive context.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_rows, lean, mapped, quoted, text_parts

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
SHORTEST = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
_CONTEXT = re.compile(r"key|secret|token|passw|pwd|auth|credential|private|bearer|signature", re.ASCII | re.IGNORECASE)
#: Characters before a candidate that make its context sensitive; characters on both sides that it is compressed with.
SENSITIVE, SURROUNDINGS = 64, 512
#: Least marginal bytes for a byte of the candidate.
NOVELTY = 0.75
_CLUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
#: Identifiers and scraps of code that are no secrets.
DICTIONARY = (
    "import from return class def self None True False public static void final private protected string integer boolean function const "
    "let var async await export default package namespace include struct typedef template unsigned char double float long short "
    "api_key= apikey: secret_key= client_secret= access_token= refresh_token= authorization: Bearer password= username= user_id session_id "
    "private_key= public_key= signature= credential= https://www.example.com/ http://localhost:8080/ index.html application/json charset=utf-8 "
    "Content-Type: text/plain; multipart/form-data ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/= 0123456789abcdef "
    "00000000000000000000000000000000 ffffffffffffffffffffffffffffffff your_api_key_here YOUR_SECRET_KEY example_token placeholder changeme "
    "configuration environment development production repository implementation initialization documentation description notification "
)

_compressor = None


def _packed(data: bytes) -> int:
    global _compressor
    if _compressor is None:
        import zstandard

        primed = zstandard.ZstdCompressionDict(DICTIONARY.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(_compressor.compress(data))


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of text[start:end], for each of its bytes, within its surroundings.

    Other occurrences of the string are not part of its surroundings, nor what the border leaves of them.
    """
    inner, n = text[start:end], end - start
    lo, hi = max(0, start - SURROUNDINGS), min(len(text), end + SURROUNDINGS)
    if (at := text.find(inner, max(0, lo - n + 1), min(start, lo + n - 1))) >= 0 and at < lo:
        lo = at + n
    if (at := text.rfind(inner, max(end, hi - n + 1), hi + n - 1)) >= 0 and at + n > hi:
        hi = at
    around = (text[lo:start].replace(inner, "") + "\n" + text[end:hi].replace(inner, "")).encode()
    raw = inner.encode()
    return (_packed(around + raw) - _packed(around)) / len(raw)


def _occurrences(text: str, candidates: list[tuple[int, int]], novel: set[str]) -> list[tuple[int, int]]:
    """Where the candidates hold a novel string, whole or as a part; what overlaps is one span."""
    heads: dict[str, list[str]] = {}
    for s in novel:
        heads.setdefault(s[:SHORTEST], []).append(s)
    out: list[tuple[int, int]] = []
    for a, z in candidates:
        inner = text[a:z]
        if inner in novel:
            out.append((a, z))
            continue
        for i in range(len(inner) - SHORTEST + 1):
            n = max((len(s) for s in heads.get(inner[i : i + SHORTEST], ()) if inner.startswith(s, i)), default=0)
            if n and out and out[-1][1] > a + i:
                out[-1] = out[-1][0], max(out[-1][1], a + i + n)
            elif n:
                out.append((a + i, a + i + n))
    return out


def _apart(spans: list[tuple[int, int]], base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that overlap none of base; both are in order."""
    k = reach = 0
    for a, z in spans:
        while k < len(base) and base[k][0] < z:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= a:
            yield a, z


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a whole text by start, then kind as listed: (kind, start, end), in code points."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    base = sorted((a, z) for _, a, z in found)
    candidates = [m.span() for m in _CANDIDATE.finditer(text)]
    novel: set[str] = set()
    for a, z in _apart(candidates, base):
        if text[a:z] not in novel and _CONTEXT.search(text, max(0, a - SENSITIVE), a) and novelty(text, a, z) >= NOVELTY:
            novel.add(text[a:z])
    if novel:
        found += [("novel", a, z) for a, z in _apart(_occurrences(text, candidates, novel), base)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _worth(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold a span: those with a clue of an assignment, or 20 characters that may be a secret's in a row."""
    out = np.zeros(len(offsets) - 1, bool)
    raw = buf.tobytes().lower()
    for clue in _CLUES:
        at = raw.find(clue)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            out[k] = True
            at = raw.find(clue, int(offsets[k + 1]) - len(clue) + 1 if offsets[k + 1] > at + len(clue) else at + 1)
    stops = np.concatenate(([-1], np.flatnonzero(~_RUN[buf]), [len(buf)]))
    long = np.flatnonzero(np.diff(stops) > 20)
    for i in long.tolist():  # a run may lie over the border of two texts; scan() decides
        a = int(np.searchsorted(offsets, stops[i] + 1, "right")) - 1
        z = int(np.searchsorted(offsets, stops[i + 1] - 1, "right"))
        out[a:z] = True
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: (id, spans array of (kind, start, end) in code points, end exclusive, by start and kind).

    Kinds: assign, access, hex (the fixed patterns), novel (incompressible strings in a sensitive context, and all
    their other occurrences in the text, that overlap no other span). Candidates of the latter are runs of SHORTEST or more
    of the characters of keys, without dots: shorter strings and the parts of a dotted token are found by the patterns or
    not at all. One row per input row, whatever its other columns; a null or empty text has an empty list. Texts of any
    length are scanned whole. Nothing is shuffled.
    """
    arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = spans_of(b.column(1))
            column = pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in x] for x in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), column], names=["id", "spans"])

    return docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t")).mapInArrow(lean(find), f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def spans_of(column: pa.Array) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
    for a, _, buf, offsets in text_parts(column):
        for k in np.flatnonzero(_worth(buf, offsets)).tolist():
            out[a + k] = scan(column[a + k].as_py() or "")
    return out


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "<SECRET>") -> str:
    """The text with each run of overlapping spans replaced."""
    parts, at = [], 0
    for _, a, z in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, z)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with all secrets replaced by a mark; ``n_chars``, where present, follows. No row goes.

    Null and empty texts, repeated rows and rows without an id stay as they are, but for their secrets; other columns may
    have any names and stay. An empty table gives no rows.
    """
    arrow_rows(docs.sparkSession)
    names = docs.columns
    at, chars = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, spans = list(b.columns), spans_of(b.column(at))
            if any(spans):
                texts = b.column(at).to_pylist()
                for k, s in enumerate(spans):
                    if s:
                        texts[k] = redacted(texts[k], s)
                columns[at] = pa.array(texts, b.schema.field(at).type)
                if chars is not None:
                    old = b.column(chars).to_pylist()
                    columns[chars] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, old, strict=True)], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return mapped(docs, change, docs.schema)
