"""Shared pieces of the training-data operators.

* ``shared_dir`` / ``save`` / ``settle`` cut lineage in the folder named by ``spark.checkpoint.dir`` so that a lost
  executor costs a re-read, not a recomputation, and nothing is left on one machine's own disk.
* ``running_offsets`` is a distributed prefix sum.
* ``words`` and ``span_hashes`` find and hash the words of a whole Arrow text column with numpy, without a Python
  object per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that numpy looks at in one go.
WINDOW = 1 << 19
#: Rows of one Arrow batch; with long texts a batch of Spark's default 10 000 rows would not fit a worker.
BATCH_ROWS = 1000

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.PCG64(20))
PLAIN = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
FOLDED = PLAIN.copy()
FOLDED[65:91] = PLAIN[97:123]
_powers = np.ones((2, 1), np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where none is configured and all run on one machine.

    On a cluster without one this raises: executors would each write to a disk of their own, and recovery would fail.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _saved[id(out)] = (weakref.ref(out), path)
    return out


#: Where the tables of save() are, by the identity of their DataFrame.
_saved: dict[int, tuple[weakref.ref, str]] = {}


def free(*tables: DataFrame) -> None:
    """Remove tables of save() that nothing reads any more."""
    for df in tables:
        known, path = _saved.pop(id(df), (lambda: None, ""))
        if known() is df:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def settle(df: DataFrame) -> DataFrame:
    """checkpoint(): like save(), but the rows of a partition stay together and in order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def arrow_rows(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most; a session that has them smaller keeps its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each made longer until no column has it (Spark's names are the same in either case)."""
    have, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


#: What kinds of tasks keep in a worker for the next task of their kind.
_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    return _kept.setdefault(kind, {})


def release(kind: str | None = None) -> None:
    """Let go of what other kinds of tasks kept, and give freed memory back to the system, which workers else hold on to."""
    for other in [k for k in _kept if k != kind]:
        del _kept[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others needn't
    if trim:
        trim(0)


def lean(rows: Callable[[Iterator], Iterator], kind: str | None = None) -> Callable[[Iterator], Iterator]:
    """A task's function that begins and ends with release(): workers are reused, and an executor's are many."""

    def run(batches: Iterator) -> Iterator:
        release(kind)
        try:
            yield from rows(batches)
        finally:
            release(kind)

    return run


def mapped(df: DataFrame, rows: Callable[[Iterator], Iterator], schema: T.StructType) -> DataFrame:
    """mapInArrow of a whole table whose columns may have any names (Spark's own takes dots for parts of a name)."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    made = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return plain.mapInArrow(lean(rows), made).toDF(*schema.names)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- prefix sums


def running_offsets(df: DataFrame, group: str, order: list[str], size: str, name: str) -> DataFrame:
    """Add column ``name``: the sum of ``size`` over the rows of the same ``group`` that come before in ``order``.

    ``group`` must be a non-null long of few values beside the rows (sources, lengths). Rows are range-partitioned by
    (group, order), so a group of any size is dealt over many tasks; only one total per (partition, group) that occurs
    reaches the driver: at most partitions + groups, as ranges are contiguous.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    dealt = settle(df.repartitionByRange(shuffle_partitions(spark), group, *order).sortWithinPartitions(group, *order))
    totals = dealt.groupBy(F.spark_partition_id().alias("_p"), F.col(group).alias("_g")).agg(F.sum(size).alias("_s")).collect()
    before: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for p, g, s in sorted((r["_p"], r["_g"], r["_s"]) for r in totals):
        base[p, g] = before.get(g, 0)
        before[g] = base[p, g] + s
    bases = spark.sparkContext.broadcast(base)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            groups, sizes = b.column(b.schema.get_field_index(group)).to_numpy(), b.column(b.schema.get_field_index(size)).to_numpy()
            out = np.cumsum(sizes) - sizes
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else []
            for a, z in zip(starts, [*starts[1:], len(groups)], strict=True):
                g = int(groups[a])
                total = int(sizes[a:z].sum())
                out[a:z] += seen.get(g, bases.value[p, g]) - out[a]
                seen[g] = seen.get(g, bases.value[p, g]) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, name])

    return dealt.mapInArrow(lean(add), T.StructType([*dealt.schema.fields, T.StructField(name, T.LongType())]))


# ---------------------------------------------------------------- texts and words


def text_parts(column: pa.Array, limit: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes (or one longer text): first row, end row, bytes, offsets; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, z, data[off[a] : off[z]], off[a : z + 1] - off[a]
        a = z


def _power_tables(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        k = max(n, 2 * WINDOW)
        _powers = np.ones((2, k), np.uint64)
        _powers[0, 1:], _powers[1, 1:] = _MULTIPLIER, _INVERSE
        np.cumprod(_powers, axis=1, out=_powers)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """64-bit hashes of the byte spans, from differences of one running polynomial over the window."""
    powers = _power_tables(len(buf) + 1)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * powers[0, : len(buf)], out=run[1:])
    return mixed((run[ends] - run[starts]) * powers[1][starts] + (ends - starts).astype(np.uint64) * PLAIN[7])


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of non-space bytes that stay within their text; ``cut`` marks bytes that begin a new one."""
    inside = ~space[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets[:-1]] = True
    first = first[: len(buf)]
    if cut is not None:
        first |= cut
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside & first
    starts[1:] |= inside[1:] & ~inside[:-1]
    starts[0] |= inside[0]
    ends = np.zeros(len(buf), bool)
    ends[-1] = inside[-1]
    ends[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED, want_spans: bool = False) -> tuple:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+` in order and the first word of each text (one more entry at the end).

    A text beyond the window is worked on in windows that end at white space, so memory beyond the results is bounded.
    """
    hashes, begins, finish = [], [], []
    a = 0
    while a < len(buf):
        z = min(len(buf), a + 2 * WINDOW)
        if z < len(buf) and z not in offsets:
            gap = np.flatnonzero(SPACE[buf[a:z]])
            if len(gap):
                z = a + int(gap[-1]) + 1
            else:
                later = np.flatnonzero(SPACE[buf[z:]])
                z = z + int(later[0]) if len(later) else len(buf)
        marks = offsets[(offsets >= a) & (offsets <= z)] - a
        s, e = word_spans(buf[a:z], np.r_[0, marks, z - a])
        hashes.append(span_hashes(buf[a:z], s, e, table))
        begins.append(s + a)
        finish.append(e + a)
        a = z
    starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, offsets)
    return (h, first, starts, np.concatenate(finish) if finish else np.zeros(0, np.int64)) if want_spans else (h, first)
