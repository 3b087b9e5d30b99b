"""Load shedding of late playback."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shed_late(df: DataFrame, rate: float = 1.0, last: int | None = None) -> DataFrame:
    """The rows of (track, sample, cts, dur, sync, late, ...) that a late player still delivers, with all their columns.

    ``late`` is how late the player is at that sample (null: in time); above two frames it counts as one frame more. At
    a sample late by over half a frame, delivery jumps to the next key frame if that is the next sample or the lateness is
    over half the way there; the way is taken off and the key frame is looked at in the same manner, with what is left.
    ``last`` bounds the key frames that may be jumped to. Rows stream in order through one task a track; (track, sample)
    must be unique.
    """
    back = Window.partitionBy("track").orderBy(F.desc("sample")).rowsBetween(Window.unboundedPreceding, -1)
    key = F.when(F.col("sync"), F.struct("sample", "cts"))
    rows = df.withColumn("_k", F.last(key, ignorenulls=True).over(back))  # the next key frame, found backwards
    fields = ["track", "sample", "cts", "dur", "late"]
    rows = rows.select(*df.columns, *(F.col(c).cast("long").alias(f"_{c}") for c in fields), F.col("_k.sample").cast("long").alias("_next"), F.col("_k.cts").cast("long").alias("_there")).sortWithinPartitions("track", "sample")
    width = len(df.columns)

    def deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, target, left, half = None, None, 0, 0.0
        for b in batches:
            kept = []
            for t, n, cts, dur, late, key, there in zip(*(c.to_pylist() for c in b.columns[width:]), strict=True):
                if t != current:
                    current, target = t, None
                if target is not None and n < target:
                    kept.append(False)
                    continue
                if target is None:
                    frame = int((dur or 0) / rate)
                    left, half = late or 0, frame // 2
                    left += frame if left > 2 * frame else 0
                target = None
                if left > half and key is not None and (last is None or key <= last):
                    way = int((there - cts) / rate)
                    if key == n + 1 or int(way / 2) < left:
                        left, target = left - way, key
                kept.append(target is None)
            yield pa.RecordBatch.from_arrays(b.columns[:width], names=b.schema.names[:width]).filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(deliver, T.StructType(list(df.schema.fields)))


def deliver(df: DataFrame, start: int, stop: int, rate: float = 1.0, keep_small: bool = False) -> DataFrame:
    """What a player gets of (track, edit, sample, t, dur, size, sync) from its key frame before ``start`` up to ``stop``.

    Delivery begins at the last sync sample at or before the sample that is shown at ``start`` (a track without samples
    there gives none) and ends before the first sample at or past ``stop``. Samples of under 4 bytes or no duration are
    left out unless ``keep_small``; empty ones always. Adds media_start and media_stop (presentation times), start and
    stop (from ``start``, over ``rate``, truncated), preroll (before ``start``) and discontinuity (a track's first).
    Extra columns stay; rows in presentation order are (edit, sample).
    """
    w = Window.partitionBy("track").orderBy("edit", "sample")
    whole = Window.partitionBy("track")
    shown = F.min(F.when(F.col("t") + F.col("dur") > start, F.struct("edit", "sample"))).over(whole)
    place = F.struct("edit", "sample")
    rows = df.withColumn("_shown", shown).where("_shown is not null")
    key = F.max(F.when(F.col("sync") & (place <= F.col("_shown")), place)).over(whole)
    rows = rows.withColumn("_from", F.coalesce(key, F.min(place).over(whole))).where(place >= F.col("_from"))
    rows = rows.withColumn("_end", F.max((F.col("t") >= stop).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_end = 0")
    some = F.col("size") > 0 if keep_small else (F.col("size") >= 4) & (F.col("dur") >= 1)
    timed = lambda x: ((x - start) / F.lit(float(rate))).cast("long")
    out = rows.where(some).withColumns({
        "media_start": F.col("t"), "media_stop": F.col("t") + F.col("dur"), "start": timed(F.col("t")), "stop": timed(F.col("t") + F.col("dur")),
        "preroll": F.col("t") < start, "discontinuity": F.row_number().over(w) == 1,
    })
    return out.drop("_shown", "_from", "_end")
