"""Sample descriptions of written tracks, with the configuration that each codec asks for.

A description is a few hundred bytes a track. What a type doesn't state (parameter sets, Dolby headers, a first header) is
taken from the track's first payload, which a partial aggregate finds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.functions.bits import AAC_RATES, Bits, ac3_frame, compose_avc_configuration, compose_descriptor, layer_header, to_start_codes, write_bits
from boxlake.functions.codecs import ALAW, PCM, ULAW
from boxlake.functions.eac3 import decoder_box, substreams
from boxlake.sources.writer import box, full

#: Object types and kinds of stream of an elementary stream descriptor; buffers and rates stated there.
MPEG4_VIDEO, AAC_AUDIO, MPEG1_AUDIO, WAVE_FORMAT = 0x20, 0x40, 0x6B, 0xC0
VISUAL, AUDIO = 4, 5
BUFFER, MOST_RATE = 15_000, 1_500_000
MPEG2_BUFFER, MPEG2_RATE = 1 << 20, 0x7FFFFFFF
#: Codes of wave formats by tag, names of pictures by code (others are YUV), no code for RGB.
WAVE_CODES = {PCM: b"lpcm", ULAW: b"ulaw", ALAW: b"alaw"}
PICTURE_NAMES = {b"\0\0\0\0": b"RGB Video", b"jpeg": b"Photo JPEG", b"mjpa": b"Motion JPEG"}
PICTURE_CODES = {"RGB24": b"\0\0\0\0", "RGB32": b"\0\0\0\0", "MJPG": b"jpeg"}

TYPE = {"handler": "string", "code": "string", "tag": "int", "object_type": "int", "width": "int", "height": "int", "depth": "int", "channels": "int", "bits": "int", "rate": "int", "specific": "binary"}
ENTRIES = "session string, track int, media string, width int, height int, entry binary"


def stream_box(track: int, object_type: int, kind: int, specific: bytes | None, buffer: int = BUFFER, most: int = MOST_RATE) -> bytes:
    """The box of an elementary stream descriptor; without specific information where that is None."""
    config = bytes([object_type, kind << 2 | 1]) + buffer.to_bytes(3, "big") + struct.pack(">II", most, 0)
    if specific is not None:
        config += compose_descriptor(5, specific)
    return full(b"esds", compose_descriptor(3, struct.pack(">HB", track, 0) + compose_descriptor(4, config) + compose_descriptor(6, b"\2\x7f")))


def picture(code: bytes, width: int, height: int, *inner: bytes, depth: int = 24, name: bytes = b"", quality: int = 0) -> bytes:
    shape = struct.pack(">HHIIIH", width, height, 72 << 16, 72 << 16, 0, 1)
    return box(code, bytes(6), struct.pack(">H", 1), bytes(12), struct.pack(">I", quality), shape, bytes([len(name)]) + name.ljust(31, b"\0"), struct.pack(">Hh", depth, -1), *inner)


def sound(code: bytes, channels: int, bits: int, rate: int, *inner: bytes, version: int = 0, compression: int = 0) -> bytes:
    whole = 45_000 if rate > 65_535 else rate
    return box(code, bytes(6), struct.pack(">HHHIHHhHI", 1, version, 0, 0, channels, bits, compression, 0, whole << 16), *inner)


def aac_configuration(specific: bytes, rate: int, channels: int) -> bytes:
    """The stated configuration, of the low complexity type if it is of two bytes; else one of the rate and channels."""
    if not specific:
        return write_bits([(2, 5), (AAC_RATES.index(rate) if rate in AAC_RATES else 0, 4), (7 if channels == 8 else channels, 4), (0, 3)])
    return bytes([2 << 3 | specific[0] & 7, specific[1]]) if len(specific) == 2 else specific


def ac3_box(first: bytes) -> bytes | None:
    """The decoder box of AC-3 from a frame, None if it is none."""
    found = ac3_frame(first)
    if found is None:
        return None
    head = Bits(first[4:8])  # behind the sync word and the checksum
    rate, size, stream, service, mode = (head.read(n) for n in (2, 6, 5, 3, 3))
    return box(b"dac3", write_bits([(rate, 2), (stream, 5), (service, 3), (mode, 3), (int(found["lfe"]), 1), (size // 2, 5), (0, 5)]))


def avc_box(specific: bytes, first: bytes) -> bytes | None:
    """The stated configuration record, or that of the parameter sets among the units of a payload in either form."""
    record = specific or compose_avc_configuration(first) or compose_avc_configuration(to_start_codes(first))
    return box(b"avcC", record) if record else None


def wave_entry(track: int, tag: int, channels: int, bits: int, rate: int, specific: bytes) -> bytes | None:
    """PCM that is indexed by its frames has the old description with sizes; other formats state their wave format."""
    if tag == PCM and rate < 65_536 and channels <= 2:
        return sound(b"sowt", channels, 8 if bits == 8 else 16, rate, struct.pack(">IIII", 1, bits // 8, bits // 8 * channels, 2), version=1, compression=-1)
    if tag not in WAVE_CODES:
        return None
    align = channels * bits // 8
    return sound(WAVE_CODES[tag], 2, 16, rate, stream_box(track, WAVE_FORMAT, AUDIO, specific or struct.pack("<HHIIHHH", tag, channels, rate, rate * align, align, bits, 0)))


def described(track: int, t: dict, first: bytes) -> tuple[str, bytes] | None:
    """(media handler, sample entry box) of a type and the first payload; None for unknown handlers and if what the codec
    needs is neither stated nor found."""
    n = lambda name, default=0: default if t.get(name) is None else int(t[name])
    handler, specific = t.get("handler"), t.get("specific") or b""
    size, made = (n("width"), n("height")), None
    match handler:
        case "h264_prefixed" | "h264_start_codes":
            inner = avc_box(specific, first)
            made = inner and ("vide", picture(b"avc1", *size, inner))
        case "divx":
            made = "vide", picture(b"mp4v", *size, stream_box(track, MPEG4_VIDEO, VISUAL, specific or layer_header(first) or b""))
        case "mpeg2_video":
            made = "vide", picture(b"mp4v", *size, stream_box(track, n("object_type"), VISUAL, specific or None, MPEG2_BUFFER, MPEG2_RATE))
        case "picture":
            code = PICTURE_CODES.get(t.get("code") or "RGB24") or t["code"].encode("latin-1")
            two = code == b"mjpa"  # pictures of two fields
            made = "vide", picture(code, *size, *[box(b"fiel", b"\2\1")] * two, depth=n("depth", 24), name=PICTURE_NAMES.get(code, b"YUV Video"), quality=512 * two)
        case "aac":
            made = "soun", sound(b"mp4a", 2, 16, n("rate"), stream_box(track, AAC_AUDIO, AUDIO, aac_configuration(specific, n("rate"), n("channels", 2))))
        case "mp3":
            made = "soun", sound(b"mp4a", 2, 16, n("rate"), stream_box(track, MPEG1_AUDIO, AUDIO, b""))
        case "mpeg_audio":
            made = "soun", sound(b"mp4a", n("channels", 2), n("bits") or 16, n("rate"), stream_box(track, n("object_type", MPEG1_AUDIO), AUDIO, None))
        case "wave":
            entry = wave_entry(track, n("tag", PCM), n("channels", 2), n("bits", 16), n("rate"), specific)
            made = entry and ("soun", entry)
        case "ac3":
            inner = ac3_box(first)
            made = inner and ("soun", sound(b"ac-3", 2, 16, n("rate"), inner))
        case "eac3":
            frames = substreams(first)
            made = ("soun", sound(b"ec-3", 2, 16, n("rate"), box(b"dec3", decoder_box(frames)))) if frames else None
        case "text":
            made = "text", box(b"c608")
    return made or None


def sample_descriptions(types: DataFrame, samples: DataFrame) -> DataFrame:
    """(session, track, media, width, height, entry) for the writer, from (session, track) with columns of TYPE and samples.

    Columns of TYPE that are missing count as null. ``handler`` is one of codecs.writer_handler(). The first payload is that
    of the least seq that isn't empty. Tracks with an unknown handler, or without what their codec needs, have no row: the
    writer describes them by their code alone. (session, track) is unique among the types.
    """
    have = [F.col(c).cast(k).alias(c) if c in types.columns else F.lit(None).cast(k).alias(c) for c, k in TYPE.items()]
    first = samples.where("octet_length(data) > 0 and seq is not null").groupBy("session", F.col("track").cast("int").alias("track")).agg(F.min_by("data", "seq").alias("first"))
    rows = types.select("session", F.col("track").cast("int").alias("track"), *have).join(first, ["session", "track"], "left")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.astype(object).where(b.notna(), None).to_dict("records"):
                found = described(int(r["track"]) + 1, r | {"specific": bytes(r["specific"] or b"")}, bytes(r["first"] or b""))
                if found:
                    out.append((r["session"], r["track"], found[0], int(r["width"] or 0), int(r["height"] or 0), found[1]))
            yield pd.DataFrame(out, columns=["session", "track", "media", "width", "height", "entry"])

    return rows.dropna(subset=["session", "track"]).mapInPandas(make, ENTRIES)
