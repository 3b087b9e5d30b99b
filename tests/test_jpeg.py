"""Pictures of two fields: what each lacks is put in, and offsets point at what they name."""

import struct

from boxlake.functions import codecs, jpeg
from boxlake.sources import entries


def segment(kind, payload):
    return bytes([0xFF, kind]) + struct.pack(">H", len(payload) + 2) + payload


SCAN = segment(0xDA, b"scan") + b"\x12\xff\x00\x34\xff\xd0\x56"
TABLE = segment(0xC4, b"own tables")


def field(*ahead, tables=TABLE, end=b"\xff\xd9"):
    return b"\xff\xd8" + b"".join(ahead) + segment(0xDB, b"first") + segment(0xDB, b"second") + segment(0xC0, b"frame") + tables + SCAN + end


def test_fields_and_markers(spark):
    standard = jpeg.standard_tables(spark)
    assert len(standard) == 420 and standard[:4] == b"\xff\xc4\x01\xa2"
    jfif, old = segment(0xE0, b"JFIF\0"), segment(0xE0, b"AVI1" + bytes([2, 0]) + bytes(8))
    cases = [
        field() + field(), field(jfif, tables=b"") + b"\0\0\0" + field(old, tables=b""), field(old) + b"\xff" + field(segment(0xE1, bytes(4) + b"mjpg" + bytes(32))) + b"\xff",
        field(segment(0xE0, b"AVI1\1")) + field(end=b""), field(end=b"") + field(), field() * 3,
    ]
    for data in cases:
        got = jpeg.repaired(data, standard)
        assert got["kind"] == "mjpa"
        new, at, before = got["data"], 0, jpeg.fields(data)
        after = jpeg.fields(new)
        assert len(after) == len(before) and all(f.whole() for f in after) and jpeg.repaired(new) == got
        for i, f in enumerate(after):
            head = next(p for k, p in f.pieces if k == 0xE1)
            size, padded, then, quant, huffman, frame, scan, first = struct.unpack(">8I", head[12:44])
            own = new[at : at + padded]
            assert own[:2] == b"\xff\xd8" and own[quant : quant + 9] == segment(0xDB, b"first") and own[frame : frame + 9] == segment(0xC0, b"frame")
            assert own[huffman : huffman + 2] == b"\xff\xc4" and own[scan : scan + len(SCAN)] == SCAN and own[first] == 0x12
            assert own[:size].endswith(b"\xff\xd9") or data in cases[3:5]
            assert size + len(f.padding) == padded and then == (0 if i == len(after) - 1 else padded)
            avi = next(p for k, p in f.pieces if k == 0xE0 and p[4:8] == b"AVI1")
            assert struct.unpack(">II", avi[10:18]) == (padded, size) and avi[8] == (2 if old in data and any(p[8:9] == b"\2" and k == 0xE0 and p[4:8] == b"AVI1" for k, p in before[i].pieces) else 1)
            kept = [(k, p) for k, p in before[i].pieces if k not in (0xE0, 0xE1, 0xC4)]
            assert [(k, p) for k, p in f.pieces if k not in (0xE0, 0xE1, 0xC4)] == kept and f.padding == before[i].padding
            at += padded
        assert at == len(new)
    assert jpeg.repaired(field(tables=b"") * 2) is None and jpeg.repaired(b"") is None and jpeg.repaired(b"\xff\xd8\xff\xdb\0\x50x") is None
    assert jpeg.repaired(field()) == {"kind": "jpeg", "data": field()}
    rows = spark.createDataFrame([(0, cases[0]), (1, None), (2, b"x"), (3, field())], "i int, d binary")
    out = {r.i: r for r in rows.select("i", jpeg.repaired_column(standard)("d").alias("p")).select("i", "p.kind", "p.data").collect()}
    assert bytes(out[0].data) == jpeg.repaired(cases[0])["data"] and [out[i].kind for i in range(4)] == ["mjpa", None, None, "jpeg"]


def test_description_of_two_fields():
    media, entry = entries.described(1, {"handler": "picture", "code": "mjpa", "width": 720, "height": 576}, b"")
    assert media == "vide" and entry.endswith(struct.pack(">I4s", 10, b"fiel") + b"\2\1") and b"\x0bMotion JPEG\0" in entry
    d = codecs.sample_entry("mjpa", entry[8:])
    assert d["valid"] and (d["width"], d["height"]) == (720, 576)
