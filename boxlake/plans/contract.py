"""Queries of the index and writing operators over the driver's tables, and the same in SQL.

``events`` is a set of tracks: one a user, samples in order of time, sizes from values, sign-ups as sync samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.functions import eac3, runs
from boxlake.functions.bits import AAC_RATES
from boxlake.functions.time import snapped_frame_duration
from boxlake.operators import index, mux, playback, session

SCALE = 90_000
MINUTE = SCALE * 60
HOUR = 36_000_000_000
EDIT = 864_000_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_MEDIA = """
WITH RECURSIVE b AS (SELECT min(epoch_us(ts)) AS base FROM events),
m AS (
  SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample,
    (epoch_us(ts) - base) * 10 AS t, round(value * 100)::BIGINT AS size, event_type = 'signup' AS is_sync,
    event_type = 'purchase' AS has_time
  FROM events, b
), s AS (SELECT *, ((t::HUGEINT * 90000) // 10000000)::BIGINT AS st FROM m),
d AS (SELECT track, sample, t, size, is_sync, greatest(1, coalesce(lead(st) OVER w, ((t + 1)::HUGEINT * 90000 // 10000000)::BIGINT) - st)::BIGINT AS delta
  FROM s WINDOW w AS (PARTITION BY track ORDER BY sample)),
q AS (SELECT track, sample, delta // 5400000 AS v FROM d),
f AS (SELECT *, CASE WHEN lag(v) OVER w IS NOT DISTINCT FROM v AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM q WINDOW w AS (PARTITION BY track ORDER BY sample)),
g AS (SELECT track, v, sum(c) OVER (PARTITION BY track ORDER BY sample) - 1 AS run FROM f),
r AS (SELECT track, run::BIGINT AS run, count(*)::BIGINT AS n, min(v) AS v FROM g GROUP BY track, run),
x AS (SELECT track, run, v, n, coalesce(sum(n) OVER w, 0)::BIGINT AS base, coalesce(sum((n * v * 5400000::HUGEINT * 10000000) // 90000) OVER w, 0)::BIGINT AS t0
  FROM r WINDOW w AS (PARTITION BY track ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT track, run, v, n, base, t0, unnest(range(n)) AS k FROM x),
times AS (SELECT track, base + k AS sample, (t0 + (k * v * 5400000::HUGEINT * 10000000) // 90000)::BIGINT AS dts, ((v * 5400000::HUGEINT * 10000000) // 90000)::BIGINT AS dur FROM e),
h AS (SELECT track, sample, t, size, is_sync, t // 36000000000 AS hour FROM m),
hc AS (SELECT track, hour AS chunk, min(sample) AS first, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes, min(t) AS t_start, max(t) + 1 AS t_end FROM h GROUP BY track, hour)
"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if sql.startswith("-- plain") else _MEDIA + sql
        return f

    return add


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, sample, t, stop, size, is_sync, has_time) from events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value", "event_type")
    base = events.select(F.min("ts").alias("ts")).scalar()
    rows = events.withColumn("base", base)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    return rows.select(
        F.col("user_id").alias("track"), (F.row_number().over(w) - 1).cast("long").alias("sample"), (F.expr("timestampdiff(MICROSECOND, base, ts)") * 10).alias("t"),
        F.round(F.col("value") * 100).cast("long").alias("size"), (kind == "signup").alias("is_sync"), (kind == "purchase").alias("has_time"),
    ).withColumn("stop", F.col("t") + 1)


def all_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track), one row each, straight from the table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("track")).distinct()


def minute_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = mux.start_deltas(media(spark, sf_dir), SCALE).withColumn("v", F.expr(f"delta div {MINUTE}"))
    return runs.encode_runs(deltas, "track", "sample", "v")


def tick_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minute_runs(spark, sf_dir).withColumn("v", F.col("v") * MINUTE)


def hour_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of an hour: (track, chunk, first, n, bytes, t_start, t_end)."""
    rows = media(spark, sf_dir).withColumn("chunk", F.expr(f"t div {HOUR}"))
    return rows.groupBy("track", "chunk").agg(F.min("sample").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("t").alias("t_start"), F.max("stop").alias("t_end"))


@query("SELECT track, sample, delta FROM d")
def stts_delta(spark, sf_dir):
    return mux.start_deltas(media(spark, sf_dir), SCALE)


@query("SELECT track, run, n, v FROM r")
def stts_rle(spark, sf_dir):
    return minute_runs(spark, sf_dir)


@query("SELECT track, base + k AS sample, v FROM e")
def rle_expand(spark, sf_dir):
    return runs.expand_runs(minute_runs(spark, sf_dir), "track").select("track", "sample", "v")


@query("SELECT track, sample, dts, dts + CASE WHEN sample < 10 THEN (sample // 5) * 500000 ELSE 0 END AS cts, dur FROM times")
def cts_prefix_sum(spark, sf_dir):
    stts = tick_runs(spark, sf_dir)
    offsets = F.explode(F.array(F.struct(F.lit(0).alias("run"), F.lit(0).cast("long").alias("v")), F.struct(F.lit(1).alias("run"), F.lit(4500).cast("long").alias("v"))))
    ctts = all_tracks(spark, sf_dir).select("track", offsets.alias("o")).select("track", "o.run", F.lit(5).cast("long").alias("n"), "o.v")
    return index.sample_times(stts, SCALE, ctts)


@query("SELECT track, sum(n * v * 5400000)::BIGINT AS ticks, ((sum(n * v * 5400000)::HUGEINT * 10000000) // 90000)::BIGINT AS duration FROM r GROUP BY track")
def total_duration(spark, sf_dir):
    return index.total_duration(tick_runs(spark, sf_dir), SCALE)


@query("SELECT m.track, m.sample, coalesce(k.sample, 0) AS sync_before FROM m ASOF LEFT JOIN (SELECT track, sample FROM m WHERE is_sync) k ON m.track = k.track AND m.sample >= k.sample")
def sync_before(spark, sf_dir):
    return runs.sync_around(media(spark, sf_dir), "track", "sample", "is_sync").select("track", "sample", "sync_before")


@query("SELECT m.track, m.sample, coalesce(k.sample, 0) AS sync_next FROM m ASOF LEFT JOIN (SELECT track, sample FROM m WHERE is_sync) k ON m.track = k.track AND m.sample < k.sample")
def sync_next(spark, sf_dir):
    return runs.sync_around(media(spark, sf_dir), "track", "sample", "is_sync").select("track", "sample", "sync_next")


@query("""
, c AS (SELECT track, sample, size, CASE WHEN sample < 8 THEN sample // 2 ELSE 4 + (sample - 8) // 3 END AS chunk FROM m)
SELECT track, sample, chunk, (chunk * 1000000 + track + coalesce(sum(size) OVER (PARTITION BY track, chunk ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM c""")
def sample_offset(spark, sf_dir):
    m = media(spark, sf_dir)
    tracks = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("track")).agg(F.count("*").alias("n"))
    long = lambda x: F.lit(x).cast("long")
    stsc = tracks.select("track", F.explode(F.array(F.struct(F.lit(0).alias("run"), long(1).alias("first_chunk"), long(2).alias("spc")), F.struct(F.lit(1).alias("run"), long(5).alias("first_chunk"), long(3).alias("spc")))).alias("x")).select("track", "x.*")
    chunks = tracks.select("track", F.explode(F.sequence(long(0), F.expr("4 + n div 3"))).alias("chunk")).withColumn("offset", F.col("chunk") * 1_000_000 + F.col("track"))
    return index.sample_offsets(m.select("track", "sample", "size"), stsc, chunks)


@query("SELECT track, CASE WHEN min(size) = max(size) THEN min(size) ELSE 0 END AS fixed, count(*)::BIGINT AS n, max(size) AS largest FROM m GROUP BY track")
def size_encode(spark, sf_dir):
    return runs.encode_sizes(media(spark, sf_dir), "track", "size")


@query("SELECT track, sample + 1 AS ordinal FROM m WHERE is_sync AND track NOT IN (SELECT track FROM m GROUP BY track HAVING bool_and(is_sync))")
def sync_list(spark, sf_dir):
    return runs.sync_list(media(spark, sf_dir), "track", "sample", "is_sync")


@query("""
, p AS (SELECT track, row_number() OVER w AS first, n AS v, lag(n) OVER w AS b FROM hc WINDOW w AS (PARTITION BY track ORDER BY chunk))
SELECT track, first, v FROM p WHERE first = 1 OR b IS DISTINCT FROM v""")
def chunk_change_points(spark, sf_dir):
    return runs.change_points(hour_chunks(spark, sf_dir), "track", "chunk", "n")


@query("""
SELECT track, 1 AS edit, sample, 864000000000 + dts AS t, least(dur, 8640000000000 - dts) AS dur FROM times
WHERE dts + dur > 0 AND dts < 8640000000000""")
def edit_map(spark, sf_dir):
    times = index.sample_times(tick_runs(spark, sf_dir), SCALE)
    long = lambda x: F.lit(x).cast("long")
    entries = F.array(F.struct(F.lit(0).alias("edit"), long(EDIT).alias("seg_dur"), long(-1).alias("media_time")), F.struct(F.lit(1).alias("edit"), long(10 * EDIT).alias("seg_dur"), long(0).alias("media_time")))
    edits = all_tracks(spark, sf_dir).select("track", F.explode(entries).alias("x")).select("track", "x.*")
    return index.edit_map(times, edits)


@query("""
, probe AS (SELECT track, t FROM m),
bounds AS (SELECT track, run, n, v, base, t0, t0 + ((n * v * 5400000::HUGEINT * 10000000) // 90000)::BIGINT AS t1, run = max(run) OVER (PARTITION BY track) AS last,
  greatest(1, ((v * 5400000::HUGEINT * 10000000) // 90000)::BIGINT) AS step FROM x)
SELECT p.track, p.t, b.base + (p.t - b.t0) // b.step AS sample FROM probe p JOIN bounds b ON p.track = b.track AND p.t >= b.t0 AND (b.last OR p.t < b.t1)""")
def time_to_sample(spark, sf_dir):
    return index.time_to_sample(media(spark, sf_dir).select("track", "t"), tick_runs(spark, sf_dir), SCALE)


@query("""
, probe AS (SELECT DISTINCT track, t FROM m),
hit AS (SELECT p.track, p.t, min(s.sample) AS sample FROM probe p JOIN times s ON p.track = s.track AND s.dts >= 0 AND s.dur > 0 AND (s.dts > p.t OR p.t < s.dts + s.dur) GROUP BY p.track, p.t)
SELECT p.track, p.t, coalesce(h.sample, -1) AS sample FROM probe p LEFT JOIN hit h USING (track, t)""")
def nearest_cover(spark, sf_dir):
    return index.nearest_cover(media(spark, sf_dir).select("track", "t"), index.sample_times(tick_runs(spark, sf_dir), SCALE))


@query("""
, fold AS (
  SELECT track, 0::BIGINT AS sample, 0::BIGINT AS chunk, 0::BIGINT AS first, 1::BIGINT AS n, coalesce(size, 0) AS bytes, t AS a, t + 1 AS z FROM m WHERE sample = 0
  UNION ALL
  SELECT m.track, m.sample, chunk + shut, CASE WHEN shut = 1 THEN m.sample ELSE first END, CASE WHEN shut = 1 THEN 1 ELSE n + 1 END,
    CASE WHEN shut = 1 THEN 0 ELSE bytes END + coalesce(m.size, 0), CASE WHEN shut = 1 THEN m.t ELSE least(a, m.t) END, CASE WHEN shut = 1 THEN m.t + 1 ELSE greatest(z, m.t + 1) END
  FROM (SELECT *, CASE WHEN bytes > 100000 OR z - a > 864000000000 THEN 1 ELSE 0 END AS shut FROM fold) f JOIN m ON m.track = f.track AND m.sample = f.sample + 1
)
SELECT track, chunk, max(first) AS first, max(n) AS n, arg_max(bytes, n) AS bytes, arg_max(a, n) AS t_start, arg_max(z, n) AS t_end FROM fold GROUP BY track, chunk""")
def chunk_fold(spark, sf_dir):
    return mux.fold_chunks(media(spark, sf_dir), 100_000, 24 * HOUR)


@query("""
, k AS (SELECT track, chunk, max(t_start) OVER (PARTITION BY track ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS merge_t FROM hc)
SELECT track, chunk, merge_t, row_number() OVER (ORDER BY merge_t, track, chunk) - 1 AS write_order FROM k""")
def merge_order(spark, sf_dir):
    return mux.merge_order(hour_chunks(spark, sf_dir)).select("track", "chunk", "merge_t", "write_order")


@query(", k AS (SELECT track, arg_min(t_start, chunk) AS t FROM hc GROUP BY track) SELECT track, t FROM k ORDER BY t, track LIMIT 1")
def head_min(spark, sf_dir):
    return mux.heads(hour_chunks(spark, sf_dir))


@query("""
, k AS (SELECT *, sum(has_time::BIGINT) OVER (PARTITION BY track ORDER BY sample ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS grp FROM m)
SELECT track, max(sample) AS last, count(*)::BIGINT AS n, sum(size)::BIGINT AS size, bool_or(is_sync) AS sync FROM k GROUP BY track, grp""")
def macro_sample(spark, sf_dir):
    return mux.macro_samples(media(spark, sf_dir), "has_time")


@query("SELECT track, sample, t FROM m WHERE t + 1 > 864000000000 AND t < 8640000000000")
def range_discard(spark, sf_dir):
    return mux.discard_range(media(spark, sf_dir), EDIT, 10 * EDIT).select("track", "sample", "t")


@query("""
, dur AS (SELECT track, sample, delta * 1000 AS dur FROM d), nom AS (SELECT track, (sum(dur) // count(*))::BIGINT AS nominal FROM dur GROUP BY track),
k AS (SELECT track, nominal, count(*) FILTER (dur * 10 > nominal * 8 AND dur * 10 < nominal * 12)::BIGINT AS kept, sum(dur) FILTER (dur * 10 > nominal * 8 AND dur * 10 < nominal * 12)::BIGINT AS s
  FROM dur JOIN nom USING (track) WHERE sample < 60 GROUP BY track, nominal)
SELECT track, nominal, kept, CASE WHEN kept > 2 THEN s // kept ELSE nominal END AS mean FROM k""")
def robust_mean_rate(spark, sf_dir):
    return mux.robust_mean(mux.start_deltas(media(spark, sf_dir), SCALE).withColumn("dur", F.col("delta") * 1000))


@query("""
, k AS (SELECT l_orderkey, l_linenumber, (400000 + (l_partkey % 40) * 1000)::BIGINT AS dur FROM lineitem), p AS (SELECT *, 10000000000 // dur AS f FROM k)
SELECT l_orderkey, l_linenumber, dur, CASE WHEN f <= 23900 THEN dur WHEN f <= 23985 THEN 417083 WHEN f <= 24100 THEN 416666 WHEN f <= 24800 THEN dur WHEN f <= 25200 THEN 400000
  WHEN f <= 29900 THEN dur WHEN f <= 29985 THEN 333666 WHEN f <= 30100 THEN 333333 ELSE dur END AS snapped FROM p""")
def rate_snap(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (400_000 + F.col("l_partkey") % 40 * 1000).alias("dur"))
    return rows.withColumn("snapped", snapped_frame_duration("dur"))


@query("""
, k AS (SELECT track, sample, t, t - lag(t) OVER (PARTITION BY track ORDER BY sample) AS gap FROM m WHERE sample < 10)
SELECT track, coalesce(bool_or(gap < 0), false) AS reordered, 1::BIGINT AS mean_dur, min(gap) FILTER (gap > 142857) AS min_gap FROM k GROUP BY track""")
def mode_decide(spark, sf_dir):
    return mux.mode_statistics(media(spark, sf_dir))


@query("""
, u AS (SELECT track, sample, t, coalesce(lead(t) OVER (PARTITION BY track ORDER BY sample) - t, 400000) AS dur, first_value(t) OVER (PARTITION BY track ORDER BY sample) AS f FROM m),
c AS (SELECT *, f + sum(dur) OVER (PARTITION BY track ORDER BY sample ROWS UNBOUNDED PRECEDING) AS z FROM u)
SELECT track, sample, ((z::HUGEINT * 90000) // 10000000 - ((z - dur)::HUGEINT * 90000) // 10000000)::BIGINT AS delta, ((t::HUGEINT * 90000) // 10000000 - ((z - dur)::HUGEINT * 90000) // 10000000)::BIGINT AS "offset" FROM c""")
def ctts_offsets(spark, sf_dir):
    m = media(spark, sf_dir)
    return mux.composition_deltas(m.withColumn("dur", F.coalesce(F.lead("t").over(mux.track()) - F.col("t"), F.lit(400_000))), SCALE)


@query("SELECT track, sample, t - (SELECT min(t) FROM m) AS t FROM m")
def align_starts(spark, sf_dir):
    return mux.align_starts(media(spark, sf_dir)).select("track", "sample", "t")


@query(", k AS (SELECT track, max(t_end) AS e FROM hc GROUP BY track) SELECT min(e) AS position FROM k")
def position_min(spark, sf_dir):
    return mux.position(hour_chunks(spark, sf_dir))


@query("""
, o AS (SELECT track, sample, size, sum(size) OVER (PARTITION BY track ORDER BY sample) - size + CASE WHEN sample % 4 = 3 THEN 7 ELSE 0 END AS o FROM m),
k AS (SELECT *, CASE WHEN lag(o + size) OVER (PARTITION BY track ORDER BY sample) = o THEN 0 ELSE 1 END AS apart FROM o),
p AS (SELECT *, sum(apart) OVER (PARTITION BY track ORDER BY sample) AS part FROM k)
SELECT track, part::BIGINT AS part, min(sample) AS first, count(*)::BIGINT AS n, min(o)::BIGINT AS "offset", sum(size)::BIGINT AS bytes FROM p GROUP BY track, part""")
def coalesce_contiguous(spark, sf_dir):
    placed = F.sum("size").over(mux.track().rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.when(F.col("sample") % 4 == 3, 7).otherwise(0)
    out = runs.coalesce_contiguous(media(spark, sf_dir).withColumn("offset", placed), "track", "sample", "offset", "size")
    return out.withColumn("part", F.col("part").cast("long"))


@query("SELECT track, CASE WHEN bool_or(has_time) THEN 'qt  ' ELSE 'mp42' END AS brand FROM m GROUP BY track")
def brand_any(spark, sf_dir):
    return mux.any_flag(media(spark, sf_dir), "track", F.col("has_time")).select("track", F.when(F.col("any"), "qt  ").otherwise("mp42").alias("brand"))


@query("SELECT DISTINCT track FROM m a WHERE NOT EXISTS (SELECT 1 FROM m k WHERE k.track = a.track AND k.is_sync)")
def recovery_needed(spark, sf_dir):
    return all_tracks(spark, sf_dir).join(media(spark, sf_dir).where("is_sync"), "track", "left_anti")


_RATES = ", ".join(map(str, AAC_RATES))


@query(f"SELECT track, sample, coalesce(([{_RATES}])[(size % 16)::INT + 1], 0)::BIGINT AS hz FROM m")
def codec_lookup(spark, sf_dir):
    table = spark.createDataFrame(list(enumerate(AAC_RATES)), "code long, hz long")
    return media(spark, sf_dir).withColumn("code", F.col("size") % 16).join(F.broadcast(table), "code", "left").select("track", "sample", F.coalesce("hz", F.lit(0).cast("long")).alias("hz"))


_FRAMES = """
, frames AS (SELECT track, sample % 8 AS substream, sample >= 8 AS dependent, size, size % 512 AS locations FROM m)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as substreams: the first eight samples are independent ones, the others depend on them by turns."""
    return media(spark, sf_dir).select(
        "track", (F.col("sample") % 8).alias("substream"), F.when(F.col("sample") < 8, eac3.INDEPENDENT).otherwise(eac3.DEPENDENT).alias("kind"),
        F.lit(7).alias("mode"), F.lit(True).alias("lfe"), F.lit(48_000).alias("rate"), F.col("size").alias("bitrate"), (F.col("size") % 512).alias("locations"),
    )


@query(_FRAMES + """
SELECT a.track, a.substream, count(b.track) AS n_dependent, coalesce(bit_or(b.locations), 0) AS locations
FROM frames a LEFT JOIN frames b ON a.track = b.track AND a.substream = b.substream AND b.dependent
WHERE NOT a.dependent GROUP BY a.track, a.substream""")
def dependent_substreams(spark, sf_dir):
    return eac3.independent_substreams(frames(spark, sf_dir)).select("track", "substream", "n_dependent", "locations")


@query(_FRAMES + "SELECT track, sum(size)::BIGINT AS bitrate, count(*) FILTER (NOT dependent) AS n_independent FROM frames GROUP BY track")
def substream_rates(spark, sf_dir):
    return eac3.track_rates(frames(spark, sf_dir))


@query("""
, ahead AS (
  SELECT track, sample, t, size % 6 * 500000000000 AS late, arg_min(k, k) AS k, arg_min(there, k) AS there
  FROM (SELECT a.track, a.sample, a.t, a.size, b.sample AS k, b.t AS there FROM m a LEFT JOIN m b ON a.track = b.track AND b.sample > a.sample AND b.is_sync)
  GROUP BY ALL
), step AS (
  SELECT track, 0::BIGINT AS sample, NULL::BIGINT AS target, 0::BIGINT AS left_, false AS passed, -1::BIGINT AS done FROM m WHERE sample = 0
  UNION ALL
  SELECT track, sample + 1, CASE WHEN skipped THEN target WHEN jumps THEN k END, CASE WHEN skipped THEN left_ WHEN jumps THEN l - (there - t) END, skipped OR jumps, sample
  FROM (
    SELECT *, NOT skipped AND l > 18000000000 AND k IS NOT NULL AND (k = sample + 1 OR (there - t) // 2 < l) AS jumps
    FROM (
      SELECT s.track, s.sample, s.target, s.left_, a.t, a.k, a.there, s.target IS NOT NULL AND s.sample < s.target AS skipped,
        CASE WHEN s.target IS NOT NULL THEN s.left_ ELSE coalesce(late, 0) + CASE WHEN late > 72000000000 THEN 36000000000 ELSE 0 END END AS l
      FROM step s JOIN ahead a ON a.track = s.track AND a.sample = s.sample
    )
  )
)
SELECT track, done AS sample FROM step WHERE done >= 0 AND NOT passed""")
def load_shedding(spark, sf_dir):
    late = (F.col("size") % 6 * 500_000_000_000).alias("late")
    rows = media(spark, sf_dir).select("track", "sample", F.col("t").alias("cts"), F.lit(HOUR).alias("dur"), F.col("is_sync").alias("sync"), late)
    return playback.shed_late(rows).select("track", "sample")


@query("""
, u AS (SELECT track, sample, t, size, is_sync, coalesce(lead(t) OVER (PARTITION BY track ORDER BY sample) - t, 400000) AS dur FROM m),
p AS (SELECT track, min(sample) AS shown FROM u WHERE t + dur > 864000000000 GROUP BY track),
k AS (SELECT track, coalesce(max(sample) FILTER (is_sync AND sample <= shown), min(sample)) AS f FROM u JOIN p USING (track) GROUP BY track),
z AS (SELECT track, f, coalesce(min(sample) FILTER (sample >= f AND t >= 8640000000000), 1000000000) AS e FROM u JOIN k USING (track) GROUP BY track, f),
v AS (SELECT * FROM u JOIN z USING (track) WHERE sample >= f AND sample < e AND size >= 4 AND dur >= 1)
SELECT track, sample, t AS media_start, t + dur AS media_stop, (t - 864000000000) // 2 AS start, (t + dur - 864000000000) // 2 AS stop, t < 864000000000 AS preroll,
  row_number() OVER (PARTITION BY track ORDER BY sample) = 1 AS discontinuity FROM v""")
def delivery(spark, sf_dir):
    m = media(spark, sf_dir)
    rows = m.select("track", F.lit(0).alias("edit"), "sample", "t", F.coalesce(F.lead("t").over(mux.track()) - F.col("t"), F.lit(400_000)).alias("dur"), "size", F.col("is_sync").alias("sync"))
    return playback.deliver(rows, EDIT, 10 * EDIT, 2.0).select("track", "sample", "media_start", "media_stop", "start", "stop", "preroll", "discontinuity")


@query("""
, k AS (SELECT track, chunk, bytes, t_start, unnest(range((bytes + 22047) // 22048)) AS piece FROM hc WHERE bytes > 0)
SELECT track, chunk, piece, t_start + piece * 22048 AS "offset", least(22048, bytes - piece * 22048) AS bytes, least(22048, bytes - piece * 22048) // 4 AS samples FROM k""")
def pcm_pieces(spark, sf_dir):
    return mux.pcm_pieces(hour_chunks(spark, sf_dir).select("track", "chunk", F.col("t_start").alias("offset"), "bytes", F.lit(4).cast("long").alias("block")))


@query()
def interleave_chunks(spark, sf_dir):
    rows = media(spark, sf_dir).select((F.col("track") % 8).alias("session"), "track", "sample", F.col("t").alias("arrival"), "t", "stop", "size", F.when(F.col("track") % 2 == 0, F.lit(HOUR)).alias("frame"))
    return mux.interleave_chunks(rows, 100_000, 24 * HOUR)


# ---------------------------------------------------------------- sessions: eight of them, a track belongs to the one of its remainder

_TRACKS = """
, ends AS (
  SELECT track % 8 AS session, track, count(*) AS n, max(t) + 1 - min(t) AS duration, sum(size)::BIGINT % 1000 AS preroll, sum(size)::BIGINT % 64 AS capabilities,
    bool_or(is_sync) AS eos, count(*) FILTER (has_time) AS queued, track % 5 <> 0 AS connected, track % 3 = 1 AS video, track % 7 <> 0 AS valid,
    CASE WHEN track % 4 > 0 THEN max(t) END AS stop
  FROM m GROUP BY track)
"""


def session_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a track with what a session asks of it."""
    size = F.sum("size")
    own = media(spark, sf_dir).groupBy("track").agg(
        F.count("*").alias("n"), (F.max("stop") - F.min("t")).alias("duration"), (size % 1000).alias("preroll"), (size % 64).alias("capabilities"),
        F.bool_or("is_sync").alias("eos"), F.count_if("has_time").alias("queued"), F.max("t").alias("_last"),
    )
    t = F.col("track")
    return own.select((t % 8).alias("session"), *own.columns[:-1], (t % 5 != 0).alias("connected"), (t % 3 == 1).alias("video"), (t % 7 != 0).alias("valid"), F.when(t % 4 > 0, F.col("_last")).alias("stop"))


@query(_TRACKS + "SELECT session, max(duration) AS duration, max(preroll) AS preroll, bit_or(capabilities) AS capabilities FROM ends GROUP BY session")
def whole_session(spark, sf_dir):
    return session.whole_session(session_tracks(spark, sf_dir))


@query(_TRACKS + "SELECT session, bool_and(eos AND queued = 0) AS finished FROM ends GROUP BY session")
def session_finished(spark, sf_dir):
    return session.finished(session_tracks(spark, sf_dir))


@query(_TRACKS + """, v AS (SELECT session, track, row_number() OVER (PARTITION BY session ORDER BY track) - 1 AS pin, count(*) OVER (PARTITION BY session) AS pins FROM ends WHERE valid)
SELECT session, track, pin, pins FROM v""")
def pin_list(spark, sf_dir):
    return session.pins(session_tracks(spark, sf_dir)).select("session", "track", "pin", "pins")


@query(_TRACKS + """, v AS (SELECT session, track, row_number() OVER (PARTITION BY session ORDER BY track) - 1 AS pin FROM ends WHERE valid),
w AS (SELECT track % 8 AS session, sample % 16 AS pin, sample, track AS writer FROM m)
SELECT session, pin, v.track, sample, writer FROM w JOIN v USING (session, pin)""")
def pin_lookup(spark, sf_dir):
    writes = media(spark, sf_dir).select((F.col("track") % 8).alias("session"), (F.col("sample") % 16).alias("pin"), "sample", F.col("track").alias("writer"))
    return session.by_pin(writes, session.pins(session_tracks(spark, sf_dir))).select("session", "pin", "track", "sample", "writer")


@query(_TRACKS + "SELECT session, coalesce(min(track) FILTER (video), min(track)) AS track FROM ends WHERE connected GROUP BY session")
def seeking_track(spark, sf_dir):
    return session.seeking_track(session_tracks(spark, sf_dir))


@query(_TRACKS + "SELECT session, arg_min(stop, track) FILTER (stop IS NOT NULL) AS stop FROM ends WHERE stop IS NOT NULL GROUP BY session")
def first_stop(spark, sf_dir):
    return session.first_answer(session_tracks(spark, sf_dir), "stop")


@query(_TRACKS + "SELECT track, 21 & ~capabilities AS lacking FROM ends")
def capabilities_lacking(spark, sf_dir):
    return session_tracks(spark, sf_dir).select("track", session.lacking("capabilities", F.lit(21).cast("long")).alias("lacking"))


@query(_TRACKS + """, p AS (SELECT track, sample, t, t + 1 AS z, size AS a, size // 2 AS b, sample % 3 AS u, sample % 4 AS w FROM m),
o AS (SELECT *, CASE u WHEN 1 THEN a WHEN 2 THEN t + a ELSE t END AS start FROM p)
SELECT track, sample, start, CASE w WHEN 1 THEN b WHEN 2 THEN z + b WHEN 3 THEN b + start ELSE z END AS stop FROM o""")
def new_positions(spark, sf_dir):
    start, stop = session.positions("t", "stop", "size", F.col("sample") % 3, F.expr("size div 2"), F.col("sample") % 4)
    return media(spark, sf_dir).select("track", "sample", start.alias("start"), stop.alias("stop"))


@query(_TRACKS + "SELECT session, 0::BIGINT AS earliest, max(duration) AS latest, 0::BIGINT AS preroll, 1.0::DOUBLE AS rate FROM ends GROUP BY session")
def available_range(spark, sf_dir):
    return session.available(session.whole_session(session_tracks(spark, sf_dir)).withColumn("rate", F.lit(None).cast("double")))


@query("SELECT track, greatest(8192, max(size) + track % 100 + 12)::BIGINT AS bytes FROM m GROUP BY track")
def buffer_bytes(spark, sf_dir):
    return runs.encode_sizes(media(spark, sf_dir), "track", "size").select("track", session.buffer_bytes("largest", F.col("track") % 100, True).alias("bytes"))


@query("""
, k AS (SELECT track, CASE WHEN count(delta) > 3 AND sum(delta * 1000) // count(*) > 0 THEN sum(delta * 1000) // count(*) ELSE 10000000 // 30 END::BIGINT AS mean FROM d WHERE sample % 16 < track % 8 GROUP BY track)
SELECT track, mean FROM k""")
def mean_duration(spark, sf_dir):
    rows = mux.start_deltas(media(spark, sf_dir), SCALE).where("sample % 16 < track % 8").withColumn("dur", F.col("delta") * 1000)
    return session.mean_duration(rows, 30)


@query("SELECT track, max((n + 1) * 4)::BIGINT AS largest FROM r GROUP BY track")
def fixed_chunk_bytes(spark, sf_dir):
    stsc = minute_runs(spark, sf_dir).select("track", "run", (F.col("n") + 1).alias("spc"))
    return session.fixed_chunk_bytes(stsc, all_tracks(spark, sf_dir).withColumn("fixed", F.lit(4).cast("long")))


@query("SELECT track, arg_min(size % 7, sample) AS codec FROM m GROUP BY track")
def offered_codec(spark, sf_dir):
    return session.offered_codec(media(spark, sf_dir).select("track", F.col("sample").alias("alternative"), (F.col("size") % 7).alias("codec")))


@query("SELECT track, arg_min(t, sample) AS t FROM m GROUP BY track")
def first_time(spark, sf_dir):
    return session.first_time(media(spark, sf_dir))


@query("""
, shown AS (SELECT track, sample, 864000000000 + dts AS t FROM times WHERE dts + dur > 0 AND dts < 8640000000000)
SELECT track, 1 AS edit, sample, CASE WHEN lead(sample) OVER w IS NULL THEN NULL ELSE 1 END::INT AS next_edit, lead(sample) OVER w AS next_sample FROM shown WINDOW w AS (PARTITION BY track ORDER BY sample)""")
def successors(spark, sf_dir):
    long = lambda x: F.lit(x).cast("long")
    entries = F.array(F.struct(F.lit(0).alias("edit"), long(EDIT).alias("seg_dur"), long(-1).alias("media_time")), F.struct(F.lit(1).alias("edit"), long(10 * EDIT).alias("seg_dur"), long(0).alias("media_time")))
    edits = all_tracks(spark, sf_dir).select("track", F.explode(entries).alias("x")).select("track", "x.*")
    return index.successors(index.sample_times(tick_runs(spark, sf_dir), SCALE), edits)


@query("""
, o AS (SELECT track, sample, t, greatest(1, coalesce(lead(t) OVER (PARTITION BY track ORDER BY sample) - t, 400000)) AS dur, is_sync FROM m),
p AS (SELECT DISTINCT track, t + 5000000 AS t FROM m WHERE t + 5000000 < 8640000000000),
hit AS (SELECT p.track, p.t, min(o.sample) AS sample FROM p JOIN o ON o.track = p.track AND (o.t > p.t OR p.t < o.t + o.dur) GROUP BY ALL)
SELECT track, t + 864000000000 AS t, 1 AS edit, coalesce((SELECT max(k.sample) FROM o k WHERE k.track = hit.track AND k.is_sync AND k.sample <= hit.sample), 0) AS sample FROM hit""")
def seek_to_key(spark, sf_dir):
    m = media(spark, sf_dir)
    samples = m.select("track", "sample", F.col("t").alias("cts"), F.greatest(F.lit(1), F.coalesce(F.lead("t").over(mux.track()) - F.col("t"), F.lit(400_000))).cast("long").alias("dur"), F.col("is_sync").alias("sync"))
    long = lambda x: F.lit(x).cast("long")
    entries = F.array(F.struct(F.lit(0).alias("edit"), long(EDIT).alias("seg_dur"), long(-1).alias("media_time")), F.struct(F.lit(1).alias("edit"), long(10 * EDIT).alias("seg_dur"), long(0).alias("media_time")))
    edits = all_tracks(spark, sf_dir).select("track", F.explode(entries).alias("x")).select("track", "x.*")
    return index.seek(m.select("track", (F.col("t") + 5_000_000 + EDIT).alias("t")), samples, edits)


@query("SELECT track, sample, t AS start, t + 1 AS stop, 16 + CASE WHEN is_sync THEN 1 ELSE 0 END::BIGINT AS flags FROM m")
def time_flags(spark, sf_dir):
    m = media(spark, sf_dir)
    return session.time_flags(m.select("track", "sample", F.col("t").alias("cts"), F.lit(1).alias("dur"), F.col("is_sync").alias("sync")))


@query("""
, c AS (SELECT track % 8 AS session, track, min(t_start) AS s, max(t_end) AS e FROM hc GROUP BY track)
SELECT session, min(e) AS running, max(e) - min(s) AS stopped FROM c GROUP BY session""")
def session_position(spark, sf_dir):
    chunks = hour_chunks(spark, sf_dir).withColumn("session", F.col("track") % 8)
    return session.final_position(chunks, False).withColumnRenamed("position", "running").join(session.final_position(chunks, True).withColumnRenamed("position", "stopped"), "session")
