"""The writing side: deltas, composition offsets, chunks, interleaving, discarding, statistics.

Sequential folds stream over rows sorted by (track, order): a track of any length is folded in bounded memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.time import UNITS, to_track

CHUNK_BYTES = 400 << 10


def track(order: str = "sample") -> Window:
    return Window.partitionBy("track").orderBy(order)


def start_deltas(df: DataFrame, scale: int) -> DataFrame:
    """(track, sample, delta): ticks to the next start, for the last to its stop (start + 1 if missing); at least 1."""
    s = to_track("t", scale)
    stop = F.coalesce(F.col("stop"), F.col("t") + 1) if "stop" in df.columns else F.col("t") + 1
    return df.select("track", "sample", F.greatest(F.lit(1), F.coalesce(F.lead(s).over(track()), to_track(stop, scale)) - s).cast("long").alias("delta"))


def composition_deltas(df: DataFrame, scale: int) -> DataFrame:
    """(track, sample, delta, offset) from (t, dur): drift-free decode ticks and composition offsets (signed)."""
    first = F.first("t").over(track().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    done = F.sum("dur").over(track().rowsBetween(Window.unboundedPreceding, 0))
    ends = df.withColumn("_c", to_track(first + done, scale)).withColumn("_b", to_track(first + done - F.col("dur"), scale))
    return ends.select("track", "sample", (F.col("_c") - F.col("_b")).alias("delta"), (to_track("t", scale) - F.col("_b")).alias("offset"))


def align_starts(df: DataFrame) -> DataFrame:
    """Times less the earliest of all tracks."""
    least = df.select(F.min("t")).scalar()
    return df.withColumn("t", F.col("t") - least)


def fold_chunks(df: DataFrame, bytes_most: int = CHUNK_BYTES, time_most: int = UNITS) -> DataFrame:
    """(track, chunk, first, n, bytes, t_start, t_end) of (track long, sample, t, stop, size).

    A sample is appended, then the chunk is closed if its bytes or its duration are over the bounds.
    """
    rows = df.select(F.col("track").cast("long"), "sample", "t", F.coalesce("stop", F.col("t") + 1).alias("stop"), "size").repartition("track").sortWithinPartitions("track", "sample")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None  # track, chunk, first, n, bytes, start, end
        for b in batches:
            out = []
            for t, s, start, stop, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if open_ is None or open_[0] != t:
                    if open_ and open_[3]:
                        out.append(open_)
                    open_ = [t, 0, s, 0, 0, start, stop]
                if not open_[3]:
                    open_[2], open_[5], open_[6] = s, start, stop
                open_[3:] = [open_[3] + 1, open_[4] + (size or 0), min(open_[5], start), max(open_[6], stop)]
                if open_[4] > bytes_most or open_[6] - open_[5] > time_most:
                    out.append(open_)
                    open_ = [t, open_[1] + 1, s, 0, 0, start, stop]
            yield _chunks(out)
        if open_ and open_[3]:
            yield _chunks([open_])

    return rows.mapInArrow(fold, "track long, chunk long, first long, n long, bytes long, t_start long, t_end long")


_CHUNK = ["track", "chunk", "first", "n", "bytes", "t_start", "t_end"]


def _chunks(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names=_CHUNK)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A number from 0 over all rows in an order, without bringing them to one task."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    placed = dealt.withColumn("_i", F.monotonically_increasing_id()).withColumns({"_p": F.shiftright("_i", 33), "_i": F.col("_i").bitwiseAND((1 << 33) - 1)})
    counts = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # one number a partition
    base, pairs = 0, []
    for p in sorted(counts):
        pairs.append((p, base))
        base += counts[p]
    bases = F.broadcast(spark.createDataFrame(pairs, "_p long, _b long"))
    return placed.join(bases, "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_b", "_i")


def merge_order(chunks: DataFrame) -> DataFrame:
    """Write order of chunks (track, chunk, t_start): earliest head first, ties to the lower track, each track a queue.

    A chunk waits for those before it in its queue, so its place is by the running maximum of its track's starts.
    """
    key = F.max("t_start").over(track("chunk").rowsBetween(Window.unboundedPreceding, 0))
    return ranked(chunks.withColumn("merge_t", key), ["merge_t", "track", "chunk"], "write_order")


def macro_samples(df: DataFrame, has_time: str) -> DataFrame:
    """Rows of one sample split over several buffers, of which the last carries the time: (track, last, n, size, sync)."""
    back = Window.partitionBy("track").orderBy(F.desc("sample"))
    after = F.sum(F.col(has_time).cast("long")).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_g", after).groupBy("track", "_g").agg(F.max("sample").alias("last"), F.count("*").alias("n"), F.sum("size").alias("size"), F.bool_or("is_sync").alias("sync")).drop("_g")


def discard_range(df: DataFrame, start: int | None, stop: int | None, monotone: bool = True) -> DataFrame:
    """Rows from the first that ends after ``start`` up to the first that begins at ``stop`` or later; None cancels a bound."""
    begins = F.lit(True) if start is None else F.col("stop") > start
    ends = F.lit(False) if stop is None else F.col("t") >= stop
    if monotone:
        return df.where(begins & ~ends)
    w = track().rowsBetween(Window.unboundedPreceding, 0)
    begun, ended = F.bool_or(begins).over(w), F.bool_or(ends).over(w)
    return df.withColumns({"_b": begun, "_e": ended}).where("_b and not _e").drop("_b", "_e")


def mode_statistics(df: DataFrame, first: int = 10) -> DataFrame:
    """(track, reordered, mean_dur, min_gap): of each track's first samples, whether a start goes back, and the least
    plausible gap (over 1/70 s)."""
    own = df.where(F.col("sample") < first).withColumn("_gap", F.col("t") - F.lag("t").over(track()))
    return own.groupBy("track").agg(F.coalesce(F.bool_or(F.col("_gap") < 0), F.lit(False)).alias("reordered"), F.expr("sum(stop - t) div count(*)").alias("mean_dur"), F.min(F.when(F.col("_gap") > UNITS // 70, F.col("_gap"))).alias("min_gap"))


def robust_mean(df: DataFrame, first: int = 60) -> DataFrame:
    """(track, nominal, kept, mean): mean of the first durations within 20 % of the nominal one, which stands if fewer
    than 3 are."""
    nominal = df.groupBy("track").agg(F.expr("sum(dur) div count(*)").alias("nominal"))
    near = (F.col("dur") * 10 > F.col("nominal") * 8) & (F.col("dur") * 10 < F.col("nominal") * 12)
    own = df.where(F.col("sample") < first).join(nominal, "track").groupBy("track", "nominal").agg(F.count_if(near).alias("kept"), F.sum(F.when(near, F.col("dur"))).alias("_s"))
    return own.select("track", "nominal", "kept", F.when(F.col("kept") > 2, F.expr("_s div nullif(kept, 0)")).otherwise(F.col("nominal")).alias("mean"))


def heads(chunks: DataFrame) -> DataFrame:
    """(track, t): of each track's head, the earliest; ties to the lower track."""
    first = chunks.groupBy("track").agg(F.min_by("t_start", "chunk").alias("t"))
    return first.agg(F.min(F.struct("t", "track")).alias("m")).select("m.track", "m.t")


def position(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("track").agg(F.max("t_end").alias("e")).agg(F.min("e").alias("position"))


def bitrate_state(df: DataFrame, rate: str) -> DataFrame:
    """Adds the running largest bitrate of the track."""
    return df.withColumn("most_rate", F.max(rate).over(track().rowsBetween(Window.unboundedPreceding, 0)))


def any_flag(df: DataFrame, key: str, flag: Column) -> DataFrame:
    return df.groupBy(key).agg(F.bool_or(flag).alias("any"))


PIECE_BYTES = 22_050


def pcm_pieces(chunks: DataFrame, most: int = PIECE_BYTES) -> DataFrame:
    """(track, chunk, piece, offset, bytes, samples) of PCM chunks (track, chunk, offset, bytes, block): full pieces of the
    most whole blocks that fit, then the rest; a piece's index holds one sample of duration 1 a block."""
    size = F.lit(most) - F.lit(most) % F.col("block")
    cut = chunks.where("bytes > 0 and block > 0").withColumn("_s", size.cast("long"))
    rows = cut.withColumn("piece", F.explode(F.expr("sequence(0L, (bytes - 1) div _s)")))
    part = F.least(F.col("_s"), F.col("bytes") - F.col("piece") * F.col("_s"))
    return rows.select("track", "chunk", "piece", (F.col("offset") + F.col("piece") * F.col("_s")).alias("offset"), part.alias("bytes"), F.expr("least(_s, bytes - piece * _s) div block").alias("samples"))


def trim_pcm(df: DataFrame, start: int) -> DataFrame:
    """PCM rows (t, stop, data, rate, block) that begin before ``start`` and end after it lose what lies before it: whole
    blocks of the time between, truncated. Rows without a stop time stay as they are, and so do all others."""
    over = (F.col("t") < start) & (F.col("stop") > start)
    excess = to_track(F.lit(start) - F.col("t"), "rate") * F.col("block")
    data = F.expr("substring(data, cast(_excess as int) + 1)")
    cut = df.withColumn("_excess", F.when(over, excess).otherwise(0))
    return cut.withColumns({"data": F.when(F.col("_excess") > 0, data).otherwise(F.col("data")), "t": F.when(over, F.lit(start).cast("long")).otherwise(F.col("t"))}).drop("_excess")


def interleave_chunks(df: DataFrame, bytes_most: int = CHUNK_BYTES, time_most: int = UNITS) -> DataFrame:
    """(session, track, chunk, first, n, bytes, t_start, t_end, bound) of (session, track, sample, arrival, t, stop, size,
    frame): chunks under a bound on time that falls as bitrates are learnt.

    Samples of a session come in order of ``arrival``. A chunk is closed when its bytes or its duration (number of samples
    times ``frame``, for null ``frame``, audio, its last end less its first start) are over the bounds; its bitrate, if
    the highest of its track so far, may lower the bound to what ``bytes_most`` last at the sum of the tracks' highest.
    The bound is the session's, so a session streams through one task; that holds one open chunk a track.
    """
    longs = ["session", "track", "arrival", "sample", "t"]
    rows = df.select(*(F.col(c).cast("long") for c in longs), F.coalesce("stop", F.col("t") + 1).cast("long").alias("stop"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("frame").cast("long"))
    rows = rows.repartition("session").sortWithinPartitions("session", "arrival", "track", "sample")
    names = ["session", *_CHUNK, "bound"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, Interleaver(bytes_most, time_most)
        for b in batches:
            made: list[list[int]] = []
            for session, t, _, sample, start, stop, size, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if session != current:
                    made += ([current, *c] for c in state.rest())
                    current, state = session, Interleaver(bytes_most, time_most)
                closed = state.add(t, sample, start, stop, size, frame)
                if closed:
                    made.append([session, *closed])
            yield _records(made, names)
        yield _records([[current, *c] for c in state.rest()], names)

    return rows.mapInArrow(fold, ", ".join(f"{n} long" for n in names))


def _records(rows: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)


class Interleaver:
    """A session's open chunks under a bound on time that falls as bitrates are learnt; one small record a track."""

    def __init__(self, bytes_most: int, time_most: int, bound: int | None = None, chunks: dict | None = None, rates: dict | None = None):
        self.bytes_most, self.bound = bytes_most, time_most if bound is None else bound
        self.chunks: dict[int, list[int]] = chunks or {}  # track: number, first, n, bytes, start, end
        self.rates: dict[int, int] = rates or {}

    def add(self, track: int, sample: int, start: int, stop: int, size: int, frame: int | None) -> list[int] | None:
        """The chunk (track, number, first, n, bytes, start, end, bound) that the sample closes, if it closes one."""
        number, first, n, held, a, z = self.chunks.get(track, (0, sample, 0, 0, start, stop))
        if not n:
            first, a, z = sample, start, stop
        n, held, a, z = n + 1, held + size, min(a, start), max(z, stop)
        length = z - a if frame is None else n * frame
        if held <= self.bytes_most and length <= self.bound:
            self.chunks[track] = [number, first, n, held, a, z]
            return None
        closed = [track, number, first, n, held, a, z, self.bound]
        self.chunks[track] = [number + 1, 0, 0, 0, 0, 0]
        rate = held * UNITS // length * 8 if length > 0 else 0
        if rate > self.rates.get(track, 0):
            self.rates[track] = rate
            self.bound = min(self.bound, UNITS * 8 * self.bytes_most // sum(self.rates.values()))
        return closed

    def rest(self) -> list[list[int]]:
        """The chunks that are still open, as they stand."""
        return [[t, *c, self.bound] for t, c in sorted(self.chunks.items()) if c[2]]
