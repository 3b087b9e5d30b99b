"""Enhanced AC-3: frame headers, the substreams of a sample, and their decoder box (ETSI TS 102 366, annexes E and F).

The mixing data on the way to the service type is read over field by field, in the standard's order and by its names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.bits import AC3_RATES, Bits, column, write_bits

#: Audio blocks of a frame by code; kinds of substreams.
BLOCKS = (1, 2, 3, 6)
INDEPENDENT, DEPENDENT = 0, 1
#: Bytes of a frame that hold its header, whatever its mixing data.
_HEADER = 256


def _mixing(b: Bits, mode: int, lfe: bool, independent: bool, blocks: int) -> None:
    """Reads over the mixing data. The fields' widths and their order (table E1.2 of the standard)."""
    if mode > 2:
        b.read(2)  # dmixmod
    if mode > 2 and mode % 2 == 1:  # three channels in front
        b.read(3)  # ltrtcmixlev
        b.read(3)  # lorocmixlev
    if mode >= 4:  # a channel behind
        b.read(3)  # ltrtsurmixlev
        b.read(3)  # lorosurmixlev
    if lfe and b.read():  # lfemixlevcode
        b.read(5)  # lfemixlevcod
    if not independent:
        return
    if b.read():  # pgmscle
        b.read(6)  # pgmscl
    if mode == 0 and b.read():  # pgmscl2e
        b.read(6)  # pgmscl2
    if b.read():  # extpgmscle
        b.read(6)  # extpgmscl
    mixdef = b.read(2)
    if mixdef == 1:
        b.read(1)  # premixcmpsel
        b.read(1)  # drcsrc
        b.read(3)  # premixcmpscl
    elif mixdef == 2:
        b.read(12)  # mixdata
    elif mixdef == 3:
        mixdeflen = b.read(5)
        b.read(8 * (mixdeflen + 2))  # mixdata
    if mode < 2:  # one channel, or two of their own
        if b.read():  # paninfoe
            b.read(8)  # panmean
            b.read(6)  # paninfo
        if mode == 0 and b.read():  # paninfo2e
            b.read(8)  # panmean2
            b.read(6)  # paninfo2
    if b.read():  # frmmixcfginfoe
        if blocks == 1:
            b.read(5)  # blkmixcfginfo
        else:
            for _ in range(blocks):
                if b.read():  # blkmixcfginfoe
                    b.read(5)  # blkmixcfginfo


def frame(data: bytes) -> dict | None:
    """Header of the frame that the data begins with; None without a sync word, with a reserved rate or cut short.

    ``kind`` 0 is an independent substream, 1 a dependent one; ``size`` is in bytes, ``bitrate`` in bits a second,
    ``locations`` are the channels of a dependent substream in the bits of the decoder box, ``service`` is 0 if not stated.
    """
    b = Bits(data[:_HEADER])
    try:
        if b.read(16) != 0x0B77:
            return None
        h = {"kind": b.read(2), "substream": b.read(3), "size": 2 * (b.read(11) + 1), "rate_code": b.read(2)}
        code = b.read(2)
        reduced = h["rate_code"] == 3
        index = code if reduced else h["rate_code"]
        if index == 3:
            return None
        h["rate"], h["blocks"] = AC3_RATES[index] // (2 if reduced else 1), 6 if reduced else BLOCKS[code]
        h["bitrate"] = h["rate"] * h["size"] * 8 // (h["blocks"] * 256)
        h |= {"mode": b.read(3), "lfe": bool(b.read()), "stream": b.read(5)}
        for _ in range(2 if h["mode"] == 0 else 1):
            b.read(5)  # dialnorm
            if b.read():  # compre
                b.read(8)  # compr
        custom = b.read(16) if h["kind"] == DEPENDENT and b.read() else 0
        h["locations"] = custom >> 6 & 0x100 | custom >> 5 & 0xFF
        if b.read():
            _mixing(b, h["mode"], h["lfe"], h["kind"] == INDEPENDENT, h["blocks"])
        h["service"] = b.read(3) if b.read() else 0
        return h
    except EOFError:
        return None


def substreams(sample: bytes) -> list[dict] | None:
    """Frames of a sample up to the first repeated independent substream; None if one of them is no frame."""
    found: list[dict] = []
    seen, at = set(), 0
    while at < len(sample):
        h = frame(sample[at : at + _HEADER])
        if h is None:
            return None
        if h["substream"] in seen:
            if h["kind"] != DEPENDENT:
                break
        elif h["kind"] != DEPENDENT:
            seen.add(h["substream"])
        found.append(h)
        at += h["size"]
    return found


def decoder_box(frames: list[dict]) -> bytes:
    """Payload of the decoder box: the rate of all substreams, then each independent one with its dependents' channels."""
    own = [h for h in frames if h["kind"] != DEPENDENT]
    fields = [(sum(h["bitrate"] for h in frames) // 1000, 13), (len(own) - 1, 3)]
    for h in own:
        others = [d["locations"] for d in frames if d["kind"] == DEPENDENT and d["substream"] == h["substream"]]
        merged = 0
        for x in others:
            merged |= x
        fields += [(h["rate_code"], 2), (h["stream"], 5), (h["service"], 5), (h["mode"], 3), (int(h["lfe"]), 1), (0, 3), (len(others), 4)]
        fields.append((merged, 9) if others else (0, 1))
    return write_bits(fields)


_FRAME = "kind:int,substream:int,size:int,rate_code:int,rate:int,blocks:int,bitrate:long,mode:int,lfe:boolean,stream:int,locations:int,service:int"
frame_column = column(frame, f"struct<{_FRAME}>")
substreams_column = column(substreams, f"array<struct<{_FRAME}>>")


def substream_table(samples: DataFrame, data: Column | str = "data") -> DataFrame:
    """(track, frame, fields of the frame) of the first sample of each track: (track, sample, data).

    Only the first sample of a track is parsed; it is found with a partial aggregate. A null or broken one gives no rows.
    """
    first = samples.groupBy("track").agg(F.min_by(F.col(data) if isinstance(data, str) else data, "sample").alias("_d"))
    return first.select("track", F.posexplode(substreams_column("_d")).alias("frame", "_h")).select("track", "frame", "_h.*")


def independent_substreams(table: DataFrame) -> DataFrame:
    """(track, substream, mode, lfe, rate, n_dependent, locations): each independent substream with its dependents folded in."""
    own = table.where(F.col("kind") != DEPENDENT).select("track", "substream", "mode", "lfe", "rate")
    others = table.where(F.col("kind") == DEPENDENT).groupBy("track", "substream").agg(F.count("*").alias("n_dependent"), F.bit_or("locations").alias("locations"))
    return own.join(others, ["track", "substream"], "left").fillna(0, ["n_dependent", "locations"])


def track_rates(table: DataFrame) -> DataFrame:
    """(track, bitrate, n_independent)."""
    return table.groupBy("track").agg(F.sum("bitrate").alias("bitrate"), F.count_if(F.col("kind") != DEPENDENT).alias("n_independent"))
