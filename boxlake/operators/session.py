"""What a reader or writer asks of a session's tracks beside their samples: pins, positions, rates, capabilities, buffers.

All are projections and aggregates of one row a track; sessions may be any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.time import UNITS, _col

#: Least bytes of a reader's buffer, bytes more for a stream of start codes.
LEAST_BUFFER, START_CODES = 8192, 12
#: Bits of a sample's flags (fixed values).
SYNC, TIME = 1, 16
#: Ways of a new position (fixed values): as it is, added to the old one, added to the start.
KEPT, ABSOLUTE, RELATIVE, INCREMENTAL = 0, 1, 2, 3


def fixed_chunk_bytes(stsc: DataFrame, sizes: DataFrame) -> DataFrame:
    """(track, largest): the largest chunk of sound of one sample size, from stsc (track, run, spc) and (track, fixed)."""
    return stsc.join(sizes, "track").groupBy("track").agg(F.max(F.col("spc") * F.col("fixed")).alias("largest"))


def frame_duration(frame: Column | str, rate: Column | str) -> Column:
    """The stated duration of a frame, or that of the rate."""
    return F.coalesce(_col(frame), (F.lit(UNITS) / _col(rate)).cast("long"))


def mean_duration(samples: DataFrame, rate: int) -> DataFrame:
    """(track, mean): the mean of (track, dur), once more than three samples are known and if it is not 0; else 1 / rate."""
    own = samples.groupBy("track").agg(F.count("dur").alias("_n"), F.expr("sum(dur) div nullif(count(dur), 0)").alias("_m"))
    return own.select("track", F.when((F.col("_n") > 3) & (F.col("_m") > 0), F.col("_m")).otherwise(F.lit(UNITS // rate).cast("long")).alias("mean"))


def whole_session(tracks: DataFrame) -> DataFrame:
    """(session, duration, preroll, capabilities) of (session, track, duration, preroll, capabilities): the longest, the
    longest and all together."""
    return tracks.groupBy("session").agg(F.max("duration").alias("duration"), F.max("preroll").alias("preroll"), F.bit_or("capabilities").alias("capabilities"))


def finished(tracks: DataFrame) -> DataFrame:
    """(session, finished): whether all of (session, track, eos, queued) are at their end with nothing queued."""
    return tracks.groupBy("session").agg(F.bool_and(F.coalesce(F.col("eos") & (F.col("queued") == 0), F.lit(False))).alias("finished"))


def offered_codec(types: DataFrame) -> DataFrame:
    """(track, codec): the first of the alternatives (track, alternative, codec)."""
    return types.groupBy("track").agg(F.min_by("codec", "alternative").alias("codec"))


def pins(tracks: DataFrame) -> DataFrame:
    """Adds ``pin``, the place from 0 of a valid track in its session, and ``pins``, their number."""
    w = Window.partitionBy("session")
    return tracks.where("valid").withColumns({"pin": (F.row_number().over(w.orderBy("track")) - 1).cast("long"), "pins": F.count("*").over(w)})


def by_pin(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Rows (session, pin, ...) with the track that the pin belongs to, of pins(); rows of unknown pins go."""
    return rows.join(of.select("session", "pin", "track"), ["session", "pin"])


def seeking_track(tracks: DataFrame) -> DataFrame:
    """(session, track): the first connected picture track, else the first connected one, of (session, track, video, connected)."""
    order = F.struct(~F.coalesce("video", F.lit(False)), "track")
    return tracks.where("connected").groupBy("session").agg(F.min_by("track", order).alias("track"))


def first_answer(tracks: DataFrame, value: str) -> DataFrame:
    """(session, value) of the first track, in order, that has one."""
    return tracks.where(F.col(value).isNotNull()).groupBy("session").agg(F.min_by(value, "track").alias(value))


def lacking(have: Column | str, wanted: Column | str) -> Column:
    """The wanted capabilities that are not there."""
    return _col(wanted).bitwiseAND(F.bitwise_not(_col(have)))


def same_type(a: Column | str, b: Column | str) -> Column:
    """Whether two media types (structs) are the same, field by field, missing fields too."""
    return _col(a).eqNullSafe(_col(b))


def positions(start: Column | str, stop: Column | str, to_start: Column | str, start_way: Column | str, to_stop: Column | str, stop_way: Column | str) -> tuple[Column, Column]:
    """The new start and stop after a request: each KEPT, ABSOLUTE, RELATIVE to the old value, a stop INCREMENTAL to the new start."""
    a, z, to_a, to_z, way_a, way_z = map(_col, (start, stop, to_start, to_stop, start_way, stop_way))
    new = F.when(way_a == ABSOLUTE, to_a).when(way_a == RELATIVE, a + to_a).otherwise(a)
    return new, F.when(way_z == ABSOLUTE, to_z).when(way_z == RELATIVE, z + to_z).when(way_z == INCREMENTAL, to_z + new).otherwise(z)


def available(movies: DataFrame) -> DataFrame:
    """(session, earliest, latest, preroll, rate) of (session, duration, rate): all of a file is there, nothing rolls in."""
    return movies.select("session", F.lit(0).cast("long").alias("earliest"), F.col("duration").alias("latest"), F.lit(0).cast("long").alias("preroll"), F.coalesce("rate", F.lit(1.0)).alias("rate"))


def final_position(chunks: DataFrame, stopped: bool) -> DataFrame:
    """(session, position) of chunks (session, track, t_start, t_end): the earliest last write while a session runs, its
    duration once it has stopped."""
    last = chunks.groupBy("session", "track").agg(F.max("t_end").alias("_e"), F.min("t_start").alias("_s"))
    return last.groupBy("session").agg((F.max("_e") - F.min("_s") if stopped else F.min("_e")).alias("position"))


def buffer_bytes(largest: Column | str, prepended: Column | str | int = 0, start_codes: bool = False) -> Column:
    """What a reader's buffer holds: the largest sample and what is put before it, LEAST_BUFFER at least."""
    return F.greatest(F.lit(LEAST_BUFFER).cast("long"), (_col(largest) + _col(prepended) + (START_CODES if start_codes else 0)).cast("long"))


def sample_properties(rows: DataFrame) -> DataFrame:
    """The properties that go with a sample when its payload is replaced: (track, sample, t, stop, sync, preroll, discontinuity)."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in rows.columns else F.lit(False).alias(c) for c in ("sync", "preroll", "discontinuity")]
    return rows.select("track", "sample", "t", "stop", *flags)


def first_time(samples: DataFrame) -> DataFrame:
    """(track, t): the time of the first sample in order, which later ones don't change."""
    return samples.groupBy("track").agg(F.min_by("t", "sample").alias("t"))


def time_flags(samples: DataFrame) -> DataFrame:
    """(track, sample, start, stop, flags): times of all samples with bits TIME and, for a sync sample, SYNC."""
    return samples.select("track", "sample", F.col("cts").alias("start"), (F.col("cts") + F.col("dur")).alias("stop"), (F.lit(TIME) + F.when(F.col("sync"), SYNC).otherwise(0)).cast("long").alias("flags"))
