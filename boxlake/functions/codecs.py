"""Sample descriptions: what a track holds, the types that it is offered as, and which types the writer takes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.bits import AAC_RATES, elementary_stream

#: Kind of description, name of its tracks, the code that it is read as (None: its own), its codes.
FAMILIES = (
    ("mpeg4", "MPEG4 Video", None, ("mp4v",)),
    ("h264", "H264 Video", None, ("avc1", "jvt1")),
    ("h263", "H263 Video", None, ("s263", "M263")),
    ("rgb", "Unknown", "\0\0\0\0", ("\0\0\0\0", "\x7d\xeb\x36\xe4", "\x7e\xeb\x36\xe4")),
    ("picture", "Video", None, ("rle ", "YUY2", "UYVY", "HDYC", "YV12", "NV12", "I420", "dvsd", "dvhd", "MJPG", "apcn")),
    ("picture", "DV Video", "dvsd", ("dvc ", "dvcp")),
    ("picture", "DV Video", "dvhd", ("dvhq", "dvh5")),
    ("picture", "Motion JPEG Video", "MJPG", ("jpeg", "mjpa", "mjpg")),
    ("picture", "Hap", "hap1", ("hap1", "HAP1", "Hap1")),
    ("picture", "Hap Alpha", "hap5", ("hap5", "HAP5", "Hap5")),
    ("picture", "Hap Alpha", "hapy", ("hapy", "HAPY", "HapY")),
    ("mpeg2", "MPEG-2 Video", None, ("mpg2", "xdvc", "xdv3")),
    ("aac", "AAC Audio", None, ("mp4a",)),
    ("wave", "Audio", None, ("lpcm", "alaw", "ulaw", "samr", "samw")),
    ("pcm", "Audio", None, ("sowt", "twos", "in24", "in32", "raw ")),
    ("text", "CC 608 Data", None, ("c608",)),
)
BY_CODE = {code: (kind, name, read or code) for kind, name, read, codes in FAMILIES for code in codes}
VIDEO = frozenset({"mpeg4", "h264", "h263", "rgb", "picture", "mpeg2"})
#: Format tags of audio.
PCM, ALAW, ULAW, MPEG, MP3, SPDIF, AAC, AAC_ENCODER, ADTS, DVM = 0x1, 0x6, 0x7, 0x50, 0x55, 0x92, 0xFF, 0x1234, 0x1600, 0x2000
#: Object types of MPEG-2 video by profile, from the simple profile to the high one.
MPEG2_PROFILES = {1: 0x60, 2: 0x61, 3: 0x62, 4: 0x63, 5: 0x64}

ENTRY = (
    "struct<kind:string,name:string,code:string,video:boolean,valid:boolean,width:int,height:int,depth:int,channels:int,bits:int,rate:int,"
    "block_align:int,bytes_per_second:int,specific:binary>"
)


def _children(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        size = size or len(data) - at
        if size < 8 or at + size > len(data):
            return
        yield kind, data[at + 8 : at + size]
        at += size


def _stream(data: bytes) -> dict | None:
    return elementary_stream(data[4:]) if len(data) > 4 and not data[0] else None


def sample_entry(code: str, data: bytes) -> dict | None:
    """The description (payload of a sample entry box); None for codes that aren't known.

    Descriptions that need a configuration and have none, or a broken one, are not valid. MPEG audio in an ``mp4a`` entry
    has kind ``mpeg_audio``.
    """
    if code not in BY_CODE:
        return None
    kind, name, read = BY_CODE[code]
    out = {"kind": kind, "name": name, "code": read, "video": kind in VIDEO, "valid": True, "specific": b""}
    if kind == "text":
        return out
    if kind in VIDEO:
        if len(data) < 78:
            return out | {"valid": False}
        out["width"], out["height"] = struct.unpack_from(">HH", data, 24)
        out["depth"] = struct.unpack_from(">H", data, 74)[0]
        if kind in ("rgb", "picture", "mpeg2"):
            return out
        at = 78
    else:
        if len(data) < 28:
            return out | {"valid": False}
        channels, bits, rate = *struct.unpack_from(">HH", data, 16), struct.unpack_from(">H", data, 24)[0]
        bits = {"in24": 24, "in32": 32}.get(code, bits)
        if kind != "wave":
            align = channels * bits // 8
            out |= {"channels": channels, "bits": bits, "rate": rate, "block_align": align, "bytes_per_second": align * rate}
        if kind == "pcm":
            return out
        version = struct.unpack_from(">H", data, 8)[0]
        at = 28 + (0, 16, 36)[version if kind == "aac" and version < 3 else 0]
        if kind == "aac" and version and data[at + 4 : at + 8] != b"wave":
            found = data.find(b"wave", 32)
            at = found - 4 if found >= 0 else at
    for box, payload in _children(data, at):
        if code == "avc1":
            if box == b"avcC":
                out["specific"] = payload
                break
        elif box in (b"d263", b"damr"):
            break
        elif box in (b"esds", b"wave"):
            inner = payload if box == b"esds" else next((p for b, p in _children(payload, 0) if b == b"esds"), None)
            stream = _stream(inner) if inner is not None else None
            plain = stream is not None and not stream["specific"]
            if plain and stream["object_type"] == 0x6B:
                out |= {"kind": "mpeg_audio", "video": False}
            elif (stream is None or plain) and box == b"esds":
                return out | {"valid": False}
            elif stream:
                out["specific"] = stream["specific"]
            if stream:
                break
    if kind == "aac" and out["kind"] == "aac" and len(out["specific"]) >= 2:
        index = (out["specific"][0] & 7) << 1 | out["specific"][1] >> 7
        out |= {"rate": AAC_RATES[index] if index < len(AAC_RATES) else 0, "channels": out["specific"][1] >> 3 & 15, "bits": 16, "block_align": 1}
        out["bytes_per_second"] = 0
    out["valid"] = kind in ("aac", "wave") or bool(out["specific"])
    return out


def sample_entries(df: DataFrame, code: str = "codec", data: str = "entry") -> DataFrame:
    """Adds ``description`` (null for unknown codes) to rows with a code and the payload of a sample entry."""
    names = [f.split(":")[0] for f in ENTRY[7:-1].split(",")]

    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for codes, entries in batches:
            found = [sample_entry(c, bytes(d)) if c is not None and d is not None else None for c, d in zip(codes, entries, strict=True)]
            yield pd.DataFrame([[(r or {}).get(n) for n in names] for r in found], columns=names, dtype=object)

    made = F.pandas_udf(parse, ENTRY)(F.col(code), F.col(data))
    return df.withColumn("description", made).withColumn("description", F.when(F.col("description.kind").isNotNull(), F.col("description")))


def display_name(name: Column | str, track: Column | str) -> Column:
    """The name of a track (numbers from 0) for people."""
    return F.concat_ws(" ", F.col(name) if isinstance(name, str) else name, ((F.col(track) if isinstance(track, str) else track) + 1).cast("string"))


# ---------------------------------------------------------------- offered types

_OFFER = "array<struct<choice:int,major:string,subtype:string,format:string,tag:int,handler:string>>"


def offered_types(d: str = "description") -> Column:
    """The types that a description is offered as, in order, with the payload change that goes with each; none if invalid."""
    kind, code, depth = F.col(f"{d}.kind"), F.col(f"{d}.code"), F.col(f"{d}.depth")

    def one(n: int, major: str, subtype, shape: str | None, tag=None, handler="plain") -> Column:
        as_ = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
        return F.struct(F.lit(n).alias("choice"), F.lit(major).alias("major"), as_(subtype, "string").alias("subtype"), as_(shape, "string").alias("format"), as_(tag, "int").alias("tag"), as_(handler, "string").alias("handler"))

    rgb = F.when(depth == 24, "RGB24").when(depth == 32, "RGB32")
    first_vol = F.when(kind == "mpeg4", "first_header").otherwise("plain")
    big_endian = F.when(code == "twos", "swapped").otherwise("plain")
    return (
        F.when(~F.coalesce(F.col(f"{d}.valid"), F.lit(False)), F.array().cast(_OFFER))
        .when(kind == "h264", F.array(one(0, "video", "H264 stream", "mpeg2video"), one(1, "video", "H264", "videoinfo2", handler="start_codes")))
        .when(kind.isin("mpeg4", "h263"), F.array(one(0, "video", "MP4V", "videoinfo"), one(1, "video", "XVID", "videoinfo", handler=first_vol), one(2, "video", "DIVX", "videoinfo", handler=first_vol)))
        .when(kind == "rgb", F.array(one(0, "video", rgb, "videoinfo")))
        .when(kind == "picture", F.array(one(0, "video", code, "videoinfo")))
        .when(kind == "mpeg2", F.array(one(0, "video", "MPEG2 video", "mpeg2video")))
        .when(kind == "aac", F.array(one(0, "audio", "AAC", "waveformatex", AAC)))
        .when(kind == "mpeg_audio", F.array(one(0, "audio", "MPEG2 audio", "waveformatex", MP3)))
        .when(kind == "pcm", F.array(one(0, "audio", "PCM", "waveformatex", PCM, big_endian)))
        .when((kind == "wave") & (F.length(f"{d}.specific") >= 18), F.array(one(0, "audio", "wave", "waveformatex", _tag(f"{d}.specific"))))
        .when(kind == "text", F.array(one(0, "line21", "byte pair", None)))
        .otherwise(F.array().cast(_OFFER))
    )


def _tag(specific: str) -> Column:
    """The little-endian format tag at the start of a wave format."""
    h = F.hex(specific)
    return F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")


# ---------------------------------------------------------------- types that the writer takes


def writer_handler(major: str = "major", subtype: str = "subtype", shape: str = "format", tag: str = "tag", bits: str = "bits", compression: str = "compression", image_size: str = "image_size", sample_size: str = "sample_size", length_field: str = "length_field") -> Column:
    """The writer's handler of an input type, null if it takes no such type."""
    c = F.col
    video, wave, info = c(major) == "video", (c(major) == "audio") & (c(shape) == "waveformatex"), c(shape) == "videoinfo"
    whole = c(image_size) == c(sample_size)
    h264 = video & c(subtype).isin("x264", "H264", "h264", "AVC1")
    rgb = (c(compression) == 0) & whole & ((c(subtype).isin("ARGB32", "RGB32") & (c(bits) == 32)) | ((c(subtype) == "RGB24") & (c(bits) == 24)))
    yuv = (c(bits) > 0) & whole & c(subtype).isin("YUY2", "UYVY", "HDYC", "YV12", "NV12", "I420")
    return (
        F.when(video & c(subtype).isin("xvid", "XVID", "DIVX", "DX50") & info, "divx")
        .when(h264 & (c(shape) == "mpeg2video") & c(length_field).between(1, 4), "h264_prefixed")
        .when(h264 & c(shape).isin("videoinfo", "videoinfo2", "uvch264", "mpeg2video"), "h264_start_codes")
        .when(video & (c(subtype) == "MPEG2 video") & (c(shape) == "mpeg2video"), "mpeg2_video")
        .when(video & info & (rgb | yuv | c(subtype).isin("MJPG", "jpeg", "mjpg")), "picture")
        .when(wave & c(tag).isin(AAC, AAC_ENCODER), "aac")
        .when(wave & c(tag).isin(PCM, ALAW, ULAW), "wave")
        .when(wave & (c(tag) == MPEG), "mpeg_audio")
        .when(wave & (c(tag) == SPDIF), "ac3")
        .when(wave & (c(subtype) == "DDPLUS"), "eac3")
        .when(wave & (c(subtype) == "ADTS") & (c(tag) == ADTS), "aac")
        .when(wave & c(subtype).isin("AC3", "DVM") & (c(tag) == DVM), "ac3")
        .when(wave & (c(subtype) == "MP3") & (c(tag) == MP3), "mp3")
        .when(wave & (c(subtype) == "AAC"), "aac")
        .when((c(major) == "line21") & (c(subtype) == "byte pair"), "text")
    )


def long_pcm(tag: Column, rate: Column, channels: Column) -> Column:
    """Whether PCM is indexed by its sample frames: below 65 536 Hz and at most two channels."""
    return (tag == PCM) & (rate < 65536) & (channels <= 2)


def object_type(profile: Column) -> Column:
    """Object type of MPEG-2 video by profile, 0 for others."""
    out = F.lit(0)
    for p, o in MPEG2_PROFILES.items():
        out = F.when(profile == p, o).otherwise(out)
    return out


def audio_object_type(tag: Column, mpeg1: Column) -> Column:
    """Object type of MPEG audio: whether its head flags name the first standard decides."""
    return F.when((tag == MPEG) & mpeg1, 0x6B).when(tag == MPEG, 0x69).otherwise(0)
