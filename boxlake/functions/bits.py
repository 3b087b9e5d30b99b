"""Bit and byte decoders of codec headers, as plain functions and Arrow UDFs over binary columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: AAC sampling frequencies by index.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
#: AC-3 sampling frequencies by code, nominal kbit/s by half of the frame size code, full channels by mode.
AC3_RATES = (48000, 44100, 32000)
AC3_KBITS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)
#: Profiles with chroma information in their parameter set.
HIGH_PROFILES = frozenset({44, 83, 86, 100, 110, 118, 122, 128, 244})


class Bits:
    """Reader of bits, most significant first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int = 1) -> int:
        if n > self.left:
            raise EOFError
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def unsigned(self) -> int:
        """Exp-Golomb."""
        zeros = 0
        while not self.read():
            zeros += 1
        return (1 << zeros) - 1 + self.read(zeros)

    def signed(self) -> int:
        n = self.unsigned()
        return (n + 1) // 2 if n & 1 else -(n // 2)


def write_bits(fields: list[tuple[int, int]]) -> bytes:
    """(value, width) fields packed from the top, padded with zeros to whole bytes."""
    value = width = 0
    for v, n in fields:
        value, width = value << n | v & ((1 << n) - 1), width + n
    pad = -width % 8
    return (value << pad).to_bytes((width + pad) // 8, "big")


def start_code_units(data: bytes) -> list[bytes]:
    """NAL units between start codes."""
    marks = [(m.start(), m.end()) for m in re.finditer(rb"\x00\x00\x01", data)]
    return [u for (_, a), (z, _) in zip(marks, [*marks[1:], (len(data), 0)], strict=False) if (u := data[a:z].rstrip(b"\x00"))]


def prefixed_units(data: bytes, width: int = 4) -> list[bytes]:
    """NAL units with their lengths before them; stops at a length beyond the data."""
    out, at = [], 0
    while at + width <= len(data):
        n = int.from_bytes(data[at : at + width], "big")
        at += width
        if not n or at + n > len(data):
            break
        out.append(data[at : at + n])
        at += n
    return out


def to_prefixed(data: bytes) -> bytes:
    return b"".join(len(u).to_bytes(4, "big") + u for u in start_code_units(data))


def to_start_codes(data: bytes, parameters: tuple[bytes, ...] = ()) -> bytes:
    """Start codes of four bytes before parameter sets, of three before others; given parameter sets go first."""
    return b"".join((b"\0\0\0\1" if u[0] & 31 in (7, 8) else b"\0\0\1") + u for u in (*parameters, *prefixed_units(data)))


def avc_configuration(data: bytes) -> dict | None:
    """Profile, level, width of length fields and parameter sets of an H.264 configuration record."""
    if len(data) < 7:
        return None
    out, at = {"profile": data[1], "compatible": data[2], "level": data[3], "length_size": (data[4] & 3) + 1, "sps": [], "pps": []}, 5
    for name, mask in (("sps", 31), ("pps", 255)):
        count, at = (data[at] & mask if at < len(data) else 0), at + 1
        for _ in range(count):
            n = int.from_bytes(data[at : at + 2], "big")
            if at + 2 + n > len(data):
                return out
            out[name].append(data[at + 2 : at + 2 + n])
            at += 2 + n
    return out


def compose_avc_configuration(data: bytes) -> bytes | None:
    """The record of the first parameter sets among a stream's units (start codes); None if one is missing."""
    units = start_code_units(data)
    sps, pps = (next((u for u in units if u[0] & 31 == k), None) for k in (7, 8))
    if sps is None or pps is None or len(sps) < 4:
        return None
    return b"\1" + sps[1:4] + b"\xff\xe1" + len(sps).to_bytes(2, "big") + sps + b"\1" + len(pps).to_bytes(2, "big") + pps


def byte_stream(data: bytes, configuration: bytes, first: bool) -> bytes | None:
    """A length-prefixed sample with start codes of four bytes; a stream's first sample has the parameter sets before it.

    None (the sample isn't delivered) without a configuration or if a length goes beyond the sample.
    """
    c = avc_configuration(configuration)
    if c is None:
        return None
    units, width = ([*c["sps"], *c["pps"]] if first else []), c["length_size"]
    at = 0
    while len(data) - at > width:
        n = int.from_bytes(data[at : at + width], "big")
        at += width
        if at + n > len(data):
            return None
        units.append(data[at : at + n])
        at += n
    return b"".join(b"\0\0\0\1" + u for u in units)


def first_header(configuration: bytes) -> bytes:
    """What goes before a stream's first MPEG-4 sample: the configuration from its video object layer on."""
    m = re.search(rb"\x00\x00\x01[\x20-\x2f]", configuration, re.DOTALL)
    return configuration[m.start() :] if m and len(configuration) - m.start() > 4 else b""


def layer_header(data: bytes) -> bytes | None:
    """The video object layer (first code 0x20) of an MPEG-4 sample, up to the start code after it."""
    m = re.search(rb"\x00\x00\x01\x20.*?(?=\x00\x00\x01.)", data, re.DOTALL)
    return m[0] if m else None


def raw_payload(unit: bytes) -> bytes:
    """Without emulation prevention bytes."""
    return re.sub(rb"\x00\x00\x03", b"\x00\x00", unit)


def _scaling(b: Bits, size: int) -> None:
    last = following = 8
    for _ in range(size):
        if following:
            following = (last + b.signed()) % 256
        last = following or last


def sequence_parameters(unit: bytes) -> dict | None:
    """Profile, compatibility, level, size after cropping and interlacing of an H.264 parameter set."""
    try:
        if not unit or unit[0] & 31 != 7:
            return None
        b = Bits(raw_payload(unit)[1:])
        profile, compatible, level = b.read(8), b.read(8), b.read(8)
        b.unsigned()
        chroma = 1
        if profile in HIGH_PROFILES:
            chroma = b.unsigned()
            if chroma == 3:
                b.read()
            b.unsigned(), b.unsigned(), b.read()
            if b.read():
                for i in range(8 if chroma != 3 else 12):
                    if b.read():
                        _scaling(b, 16 if i < 6 else 64)
        b.unsigned()
        order = b.unsigned()
        if order == 0:
            b.unsigned()
        elif order == 1:
            b.read(), b.signed(), b.signed()
            for _ in range(b.unsigned()):
                b.signed()
        b.unsigned(), b.read()
        width, height = (b.unsigned() + 1) * 16, (b.unsigned() + 1) * 16
        frames = b.read()
        if not frames:
            height *= 2
            b.read()
        b.read()
        if b.read():
            across, down = (1 if chroma in (0, 3) else 2), (2 if chroma == 1 else 1) * (2 - frames)
            left, right, top, bottom = (b.unsigned() for _ in range(4))
            width, height = width - across * (left + right), height - down * (top + bottom)
        return {"profile": profile, "compatible": compatible, "level": level, "width": width, "height": height, "interlaced": not frames}
    except EOFError:
        return None


def slice_frame_number(unit: bytes, width: int) -> int | None:
    """Frame number of a slice (unit types 1, 2 and 5) whose parameter set gives it ``width`` bits."""
    if not unit or unit[0] & 31 not in (1, 2, 5):
        return None
    b = Bits(raw_payload(unit[:64])[1:])
    try:
        _first, _kind, _parameters = b.unsigned(), b.unsigned(), b.unsigned()
        return b.read(width)
    except EOFError:
        return None


def enhancement(unit: bytes) -> dict | None:
    """Type, length and place of the payload of a unit's first enhancement message; both are sums that go on after 255."""
    m = re.match(rb"(\xff*)([^\xff])(\xff*)([^\xff])", unit[1:], re.DOTALL)
    if not m:
        return None
    return {"type": 255 * len(m[1]) + m[2][0], "length": 255 * len(m[3]) + m[4][0], "at": 1 + m.end()}


def audio_config(data: bytes) -> dict | None:
    """Object type, rate and channels of an AudioSpecificConfig."""
    try:
        b = Bits(data)
        kind, index = b.read(5), b.read(4)
        rate = b.read(24) if index == 15 else AAC_RATES[index] if index < len(AAC_RATES) else 0
        return {"object_type": kind, "rate": rate, "channels": b.read(4)}
    except EOFError:
        return None


def without_adts(data: bytes) -> bytes:
    """The frame without its header of 7 bytes (9 with a checksum), if the header's length is that of the data."""
    if len(data) >= 7 and data[0] == 0xFF and data[1] & 0xF6 == 0xF0 and (data[3] & 3) << 11 | data[4] << 3 | data[5] >> 5 == len(data):
        return data[7 if data[1] & 1 else 9 :]
    return data


def ac3_frame(data: bytes) -> dict | None:
    """Rate, kbit/s, channels and low-frequency channel of an AC-3 frame."""
    try:
        b = Bits(data[:16])
        if b.read(16) != 0x0B77:
            return None
        b.read(16)
        rate, size, stream, mode, channels = b.read(2), b.read(6), b.read(5), b.read(3), b.read(3)
        if rate == 3 or size >= 38 or stream > 10:
            return None
        b.read(2 * (channels & 1 and channels != 1) + 2 * bool(channels & 4) + 2 * (channels == 2))
        low = b.read()
        return {"rate": AC3_RATES[rate], "kbits": AC3_KBITS[size // 2], "mode": mode, "channels": AC3_CHANNELS[channels] + low, "lfe": bool(low)}
    except EOFError:
        return None


def descriptor(data: bytes) -> tuple[int, bytes, int] | None:
    """Tag, payload and whole length of a descriptor; its length is in groups of 7 bits, high group first."""
    n, at = 0, 1
    while at < len(data) and at <= 4:
        n = n << 7 | data[at] & 127
        at += 1
        if not data[at - 1] & 128:
            return (data[0], data[at : at + n], at + n) if at + n <= len(data) else None
    return None


def compose_descriptor(tag: int, payload: bytes) -> bytes:
    n, groups = len(payload), [len(payload) & 127]
    while n := n >> 7:
        groups.insert(0, n & 127 | 128)
    return bytes([tag, *groups]) + payload


def elementary_stream(data: bytes) -> dict | None:
    """Object type and specific information of an ES descriptor."""
    outer = descriptor(data)
    if not outer or outer[0] != 3 or len(outer[1]) < 3:
        return None
    flags, at = outer[1][2], 3
    at += 2 * bool(flags & 128)
    if flags & 64:
        at += 1 + outer[1][at]
    at += 2 * bool(flags & 32)
    config = descriptor(outer[1][at:])
    if not config or config[0] != 4 or len(config[1]) < 13:
        return None
    inner = descriptor(config[1][13:])
    return {"object_type": config[1][0], "mpeg_audio": config[1][0] in (0x6B, 0x69), "specific": inner[1] if inner and inner[0] == 5 else b""}


def swapped(data: bytes, width: int = 2) -> bytes:
    """Values of 2, 4 or 8 bytes in the other byte order; what is left over at the end stays."""
    whole = len(data) // width * width
    return np.frombuffer(data, f"<u{width}", whole // width).byteswap().tobytes() + data[whole:]


def column(f: Callable, kind: str) -> Callable[[Column | str], Column]:
    """A decoder as a vectorised function of a binary column; null stays null."""

    names = [x.split(":")[0].strip() for x in kind[7:-1].split(",")] if kind.startswith("struct") else []

    def values(s: pd.Series) -> list:
        return [None if v is None else f(bytes(v)) for v in s]

    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(values(s), dtype=object)

    def fields(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([[(v or {}).get(n) for n in names] for v in values(s)], columns=names, dtype=object)

    made: list = []

    def apply(data: Column | str) -> Column:
        if not made:
            made.append(F.pandas_udf(fields if names else plain, kind))
        return made[0](data)

    return apply


sps_column = column(sequence_parameters, "struct<profile:int,compatible:int,level:int,width:int,height:int,interlaced:boolean>")
enhancement_column = column(enhancement, "struct<type:int,length:int,at:int>")
ac3_column = column(ac3_frame, "struct<rate:int,kbits:int,mode:int,channels:int,lfe:boolean>")
aac_column = column(audio_config, "struct<object_type:int,rate:int,channels:int>")
adts_column = column(without_adts, "binary")
prefixed_column = column(to_prefixed, "binary")
start_code_column = column(to_start_codes, "binary")
swapped_column = column(swapped, "binary")
layer_column = column(layer_header, "binary")
configuration_column = column(compose_avc_configuration, "binary")
