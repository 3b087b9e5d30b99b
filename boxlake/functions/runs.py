"""Run-length, change-point, constant-or-list and sync encodings; all per key, in the order of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encode_runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run from 0, n, v): runs of equal neighbouring values."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.select(key, order, value, changed.alias("_c")).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(key, "run").agg(F.count("*").alias("n"), F.min(value).alias("v"))


def expand_runs(runs: DataFrame, key: str) -> DataFrame:
    """(key, sample from 0, run, k, v): the values again; runs of no values give none."""
    w = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    based = runs.withColumn("_base", F.coalesce(F.sum("n").over(w), F.lit(0))).where("n > 0")
    return based.select(key, "run", "v", "_base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select(key, (F.col("_base") + F.col("k")).alias("sample"), "run", "k", "v")


def change_points(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, first from 1, v): where the value differs from the one before."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = df.select(key, F.row_number().over(w).cast("long").alias("first"), F.col(value).alias("v"), F.lag(value).over(w).alias("_b"))
    return numbered.where((F.col("first") == 1) | ~F.col("_b").eqNullSafe(F.col("v"))).drop("_b")


def encode_sizes(df: DataFrame, key: str, size: str) -> DataFrame:
    """(key, fixed, n, largest): the one size of all rows, or 0 if they differ."""
    return df.groupBy(key).agg(F.when(F.min(size) == F.max(size), F.min(size)).otherwise(0).cast("long").alias("fixed"), F.count("*").alias("n"), F.max(size).alias("largest"))


def sync_list(df: DataFrame, key: str, order: str, sync: str) -> DataFrame:
    """(key, ordinal from 1) of sync rows; keys whose rows all are sync have none."""
    w = Window.partitionBy(key)
    numbered = df.select(key, sync, F.row_number().over(w.orderBy(order)).cast("long").alias("ordinal"), F.bool_and(sync).over(w).alias("_all"))
    return numbered.where(F.col(sync) & ~F.col("_all")).select(key, "ordinal")


def sync_around(df: DataFrame, key: str, order: str, sync: str) -> DataFrame:
    """Adds sync_before (at or before the row, else 0) and sync_next (after it, else 0)."""
    w, back = Window.partitionBy(key).orderBy(order), Window.partitionBy(key).orderBy(F.desc(order))
    own = F.when(F.col(sync), F.col(order))
    # What follows is looked for backwards: a frame that grows is kept up, one that shrinks would be read anew for each row.
    return df.withColumns({
        "sync_before": F.coalesce(F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0).cast("long")),
        "sync_next": F.coalesce(F.last(own, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
    })


def coalesce_contiguous(df: DataFrame, key: str, order: str, offset: str, size: str, below: int | None = None) -> DataFrame:
    """(key, part, first, n, offset, bytes): runs of rows whose bytes follow one another.

    With ``below`` only rows of fewer bytes are joined (the reader's rule for old PCM, whose samples are a few bytes).
    """
    w = Window.partitionBy(key).orderBy(order)
    follows = F.lag(F.col(offset) + F.col(size)).over(w) == F.col(offset)
    if below is not None:
        follows = follows & (F.col(size) < below) & (F.lag(size).over(w) < below)
    apart = F.when(follows, 0).otherwise(1)
    marked = df.withColumn("_a", apart).withColumn("part", F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "part").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.min(offset).alias("offset"), F.sum(size).alias("bytes"))
