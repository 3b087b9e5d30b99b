"""Time arithmetic. Times are LONG ticks of 100 ns or of a track's timescale; divisions truncate toward zero.

Products go through DECIMAL(38,0), so they don't wrap where 64 bits would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 10_000_000
#: Largest fps * 1000 of each band, and the rate that the band stands for (fixed values; None: left as it is).
RATE_BANDS = ((23_900, None), (23_985, (24_000, 1001)), (24_100, (24, 1)), (24_800, None), (25_200, (25, 1)), (29_900, None), (29_985, (30_000, 1001)), (30_100, (30, 1)))


def _col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def mul_div(a: Column | str, b: Column | str | int, c: Column | str | int) -> Column:
    """a * b / c, truncated, without overflow of the product."""
    return _div(_col(a).cast("decimal(20,0)") * _col(b).cast("decimal(18,0)"), c)


def _div(wide: Column, c: Column | str | int) -> Column:
    d = F.nullif(_col(c).cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return ((wide - wide % d) / d).cast("decimal(38,0)").cast("long")


def to_reference(ticks: Column | str, scale: Column | str | int) -> Column:
    """Track ticks to 100 ns."""
    return mul_div(ticks, UNITS, scale)


def to_track(t: Column | str, scale: Column | str | int) -> Column:
    """100 ns to track ticks, truncated (the writer's rule)."""
    return mul_div(t, scale, UNITS)


def to_track_rounded(t: Column | str, scale: Column | str | int) -> Column:
    """100 ns to track ticks, half up (the reader's rule)."""
    wide = _col(t).cast("decimal(20,0)") * _col(scale).cast("decimal(18,0)") + F.lit(UNITS // 2).cast("decimal(18,0)")
    return _div(wide, UNITS)


def snapped_frame_duration(duration: Column | str) -> Column:
    """Frame durations of the common rates exactly; others as they are."""
    d = _col(duration)
    fpsk = mul_div(F.lit(UNITS * 1000), 1, d)
    out = F.lit(None).cast("long")
    for most, rate in reversed(RATE_BANDS):
        out = F.when(fpsk <= most, F.lit(UNITS * rate[1] // rate[0]) if rate else d).otherwise(out)
    return F.coalesce(out, d)


def bitrate(size: Column | str, duration: Column | str) -> Column:
    return mul_div(_col(size), UNITS, duration) * 8


def interleave(total_bitrate: Column | str, before: Column | str | int = UNITS, chunk_bytes: int = 400 << 10) -> Column:
    """The chunk duration that holds chunk_bytes at a bitrate, if shorter than before."""
    return F.least(_col(before), mul_div(F.lit(UNITS * 8), chunk_bytes, total_bitrate))


def audio_scale(rate: Column | str) -> Column:
    return F.when(_col(rate) > 65535, F.lit(45000)).otherwise(_col(rate))


def stream_time(t: Column | str, start: Column | str | int, rate: Column | str | float = 1.0) -> Column:
    return ((_col(t) - _col(start)) / F.lit(rate)).cast("long") if isinstance(rate, float) else ((_col(t) - _col(start)) / _col(rate)).cast("long")
