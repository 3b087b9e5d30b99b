"""The sample index: time, size and place of every sample from run tables, and lookups in it.

Joins have the track as an equi-key. Lookups of a place in a track's runs are no joins: probes and run starts are sorted
together, one pass finds each probe's run, so the work is that of a sort however many runs and probes a track has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.runs import expand_runs
from boxlake.functions.time import to_reference

COUNT = Window.unboundedPreceding


def as_of(probes: DataFrame, marks: DataFrame, at: str, following: bool = False) -> DataFrame:
    """Probes (track, at, ...) with ``_m``: the last of the track's marks (track, _at, _rank, ...) at or before them, of
    marks at one place that of the highest rank; with ``following`` the first mark past them. Probes without one go."""
    p = probes.select("track", F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*probes.columns).alias("_p"))
    m = marks.where("_at is not null").select("track", "_at", F.lit(0).alias("_kind"), F.struct(*marks.columns).alias("_m"))
    order = ["_at", "_kind", "_m._rank"]
    w = Window.partitionBy("track").orderBy(*(map(F.desc, order) if following else order))  # what follows is found backwards
    near = F.last("_m", ignorenulls=True).over(w.rowsBetween(COUNT, -1 if following else 0))
    found = p.unionByName(m, allowMissingColumns=True).withColumn("_m", near)
    return found.where("_kind = 1 and _m is not null").select("_p.*", "_m")


def sample_times(stts: DataFrame, scale: Column | int, ctts: DataFrame | None = None, compat: str | None = None) -> DataFrame:
    """(track, sample, dts, cts, dur) in 100 ns from runs (track, run, n, v) of ticks.

    Time is truncated once a finished run and once within the run. ``compat="bulk_times"`` adds composition offsets
    unscaled.
    """
    key = Window.partitionBy("track").orderBy("run").rowsBetween(COUNT, -1)
    based = stts.select("track", "n", "v", F.coalesce(F.sum("n").over(key), F.lit(0)).alias("_b"), F.coalesce(F.sum(to_reference(F.col("n") * F.col("v"), scale)).over(key), F.lit(0)).alias("_t"))
    rows = based.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    out = rows.select("track", (F.col("_b") + F.col("k")).alias("sample"), (F.col("_t") + to_reference(F.col("k") * F.col("v"), scale)).alias("dts"), to_reference("v", scale).alias("dur"))
    if ctts is None:
        return out.select("track", "sample", "dts", F.col("dts").alias("cts"), "dur")
    offset = expand_runs(ctts, "track").select("track", "sample", F.col("v").alias("_o"))
    added = F.coalesce("_o", F.lit(0)) if compat == "bulk_times" else F.coalesce(to_reference("_o", scale), F.lit(0))
    return out.join(offset, ["track", "sample"], "left").select("track", "sample", "dts", (F.col("dts") + added).alias("cts"), "dur")


def total_duration(stts: DataFrame, scale: Column | int) -> DataFrame:
    return stts.groupBy("track").agg(F.sum(F.col("n") * F.col("v")).alias("ticks")).select("track", "ticks", to_reference("ticks", scale).alias("duration"))


def sample_offsets(sizes: DataFrame, stsc: DataFrame, chunks: DataFrame) -> DataFrame:
    """(track, sample, chunk, offset): sizes (track, sample, size), stsc (track, run, first_chunk from 1, spc), chunks
    (track, chunk from 0, offset). The last run goes on to the end; a sample past the last chunk has offset 0."""
    w = Window.partitionBy("track").orderBy("run")
    spans = stsc.withColumn("_next", F.lead("first_chunk").over(w)).withColumn("_n", (F.col("_next") - F.col("first_chunk")) * F.col("spc"))
    marks = spans.select("track", F.coalesce(F.sum("_n").over(w.rowsBetween(COUNT, -1)), F.lit(0)).alias("_at"), F.col("run").alias("_rank"), "first_chunk", "spc")
    at = as_of(sizes.select("track", "sample", "size"), marks, "sample")
    placed = at.select("track", "sample", "size", F.expr("_m.first_chunk - 1 + (sample - _m._at) div nullif(_m.spc, 0)").alias("chunk"))
    inside = Window.partitionBy("track", "chunk").orderBy("sample").rowsBetween(COUNT, -1)
    summed = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return summed.join(chunks, ["track", "chunk"], "left").select("track", "sample", "chunk", F.coalesce(F.col("offset") + F.col("_in"), F.lit(0)).alias("offset"))


def time_to_sample(probes: DataFrame, stts: DataFrame, scale: int) -> DataFrame:
    """Probes (track, t in 100 ns) to the sample that decodes then: division in the run, the last run open-ended, no
    step below one tick."""
    w = Window.partitionBy("track").orderBy("run").rowsBetween(COUNT, -1)
    begun = F.coalesce(F.sum(to_reference(F.col("n") * F.col("v"), scale)).over(w), F.lit(0))
    step = F.greatest(to_reference("v", scale), F.lit(1))
    marks = stts.where("n > 0").select("track", begun.alias("_at"), F.col("run").alias("_rank"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"), step.alias("step"))
    return as_of(probes.select("track", "t"), marks, "t").select("track", "t", F.expr("_m.first + (t - _m._at) div _m.step").alias("sample"))


def nearest_cover(probes: DataFrame, samples: DataFrame) -> DataFrame:
    """Probes (track, t) to the first sample (track, sample, cts, dur) that is later than or covers t; -1 if none."""
    ends = samples.where("cts >= 0 and dur > 0").select("track", "sample", (F.col("cts") + F.col("dur")).alias("_at"))
    before = F.max("_at").over(Window.partitionBy("track").orderBy("sample").rowsBetween(COUNT, -1))
    # Only a sample that ends later than all before it can be the first that ends past a time.
    marks = ends.withColumn("_b", before).where("_b is null or _at > _b").select("track", "_at", F.col("sample").alias("_rank"))
    wanted = probes.select("track", "t").distinct()
    found = as_of(wanted, marks, "t", following=True).select("track", "t", F.col("_m._rank").alias("sample"))
    return wanted.join(found, ["track", "t"], "left").select("track", "t", F.coalesce("sample", F.lit(-1)).cast("long").alias("sample"))


def segment_starts(edits: DataFrame) -> DataFrame:
    """Edits (track, edit, seg_dur, media_time) with seg_start, the sum of the durations before."""
    return edits.withColumn("seg_start", F.coalesce(F.sum("seg_dur").over(Window.partitionBy("track").orderBy("edit").rowsBetween(COUNT, -1)), F.lit(0)))


def edit_map(samples: DataFrame, edits: DataFrame, compat: str | None = None) -> DataFrame:
    """(track, edit, sample, t, dur): presentation times of samples in non-empty segments, durations cut at their ends.

    ``compat="segment_stop"`` ends a segment at the first sample in decoding order past its end.
    """
    live = segment_starts(edits).where("media_time >= 0")
    rel = samples.join(live, "track").withColumn("_rel", F.col("cts") - F.col("media_time"))
    inside = (F.col("_rel") + F.col("dur") > 0) & (F.col("_rel") < F.col("seg_dur"))
    if compat == "segment_stop":
        w = Window.partitionBy("track", "edit").orderBy("sample").rowsBetween(COUNT, 0)
        kept = rel.where("_rel + dur > 0").withColumn("_ok", F.bool_and(F.col("_rel") < F.col("seg_dur")).over(w)).where("_ok")
    else:
        kept = rel.where(inside)
    return kept.select("track", "edit", "sample", (F.col("seg_start") + F.col("_rel")).alias("t"), F.least("dur", F.col("seg_dur") - F.col("_rel")).alias("dur"))


def segment_of(probes: DataFrame, edits: DataFrame) -> DataFrame:
    """Probes (track, t) to (edit, media time): an empty segment sends a time on to the next one's start."""
    w = Window.partitionBy("track").orderBy(F.desc("edit"))
    all_ = segment_starts(edits).withColumns({"_next": F.last(F.when(F.col("media_time") >= 0, F.struct("edit", "seg_start", "media_time")), ignorenulls=True).over(w.rowsBetween(COUNT, -1))})
    marks = all_.select("track", F.col("seg_start").alias("_at"), F.col("edit").alias("_rank"), "seg_dur", "media_time", "_next")
    hit = as_of(probes.select("track", "t"), marks, "t").where("t < _m._at + _m.seg_dur").select("track", "t", F.col("_m._rank").alias("edit"), "_m.media_time", F.col("_m._at").alias("seg_start"), "_m._next")
    full = F.col("media_time") >= 0
    return hit.select("track", "t", F.when(full, F.col("edit")).otherwise(F.col("_next.edit")).alias("edit"), F.when(full, F.col("media_time") + F.col("t") - F.col("seg_start")).otherwise(F.col("_next.media_time")).alias("media"))


def seek(probes: DataFrame, samples: DataFrame, edits: DataFrame, to_key: bool = True) -> DataFrame:
    """Probes (track, t of presentation) to (track, t, edit, sample): the sample that is shown at t, or with ``to_key`` the
    last sync sample at or before it. Samples are (track, sample, cts, dur, sync); a time that no segment or no sample
    covers gives no row."""
    media = segment_of(probes, edits).where("media is not null").distinct()
    shown = nearest_cover(media.select("track", F.col("media").alias("t")), samples).where("sample >= 0").select("track", F.col("t").alias("media"), "sample")
    found = media.join(shown, ["track", "media"]).select("track", "t", "edit", "sample")
    if not to_key:
        return found
    keys = samples.where("sync").select("track", F.col("sample").alias("_at"), F.lit(0).alias("_rank"))
    return as_of(found, keys.unionByName(samples.select("track").distinct().select("track", F.lit(0).cast("long").alias("_at"), F.lit(-1).alias("_rank"))), "sample").select("track", "t", "edit", F.col("_m._at").alias("sample"))


def successors(samples: DataFrame, edits: DataFrame) -> DataFrame:
    """(track, edit, sample, next_edit, next_sample): what is shown after each sample, the next one of its segment or else
    the first of the next segment; null after the last."""
    w = Window.partitionBy("track").orderBy("edit", "sample")
    return edit_map(samples, edits).select("track", "edit", "sample", F.lead("edit").over(w).alias("next_edit"), F.lead("sample").over(w).alias("next_sample"))
