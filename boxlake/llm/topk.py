"""Exact top-k search by a three-phase uniform threshold.

The components are split in a few lists; an object's score is the sum of its entries in the lists.

1. Every task gathers, for each query and list, its k best entries. Only these few get their totals. The k-th best total
   among the best entries of all tasks is a safe cutoff: k objects reach it.
2. The cutoff is broadcast. An object that reaches it has, in some list, at least the cutoff divided by the number of
   lists; each task collects all such entries.
3. What remains of their scores is resolved exactly where the vectors are, and what reaches the cutoff is ranked.

Numbers are whole throughout: doubles while every sum is below 2^53, 64-bit integers while every sum is below 2^62, and
Python's integers beyond, which travel as bytes that sort like the numbers. Queries are taken in blocks of a fixed number,
so what is broadcast and collected is bounded; a block's results are written before the next one begins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlake.llm.ann import usable
from boxlake.llm.common import arrow_rows, fresh_path, lean, quoted, settle

LISTS, QUERY_BLOCK = 2, 4096
#: Bytes of one block of queries, at most about.
BLOCK_BYTES = 1 << 25
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
RESULT = "query_id long, rank int, vec_id long, score long"


# ---------------------------------------------------------------- whole numbers


def whole_numbers(x: np.ndarray, kind: str) -> np.ndarray:
    """floor(256 * x), x as double: in doubles ("double"), 64-bit integers ("long") or Python's integers ("big")."""
    x = x.astype(np.float64)
    if kind != "big":
        out = np.floor(256.0 * x)
        return out if kind == "double" else out.astype(np.int64)
    with np.errstate(over="ignore"):
        scaled = np.floor(256.0 * x)
    flat = [int(s) if np.isfinite(s) else 256 * int(v) for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist(), strict=True)]
    return np.array(flat, object).reshape(x.shape)


def kind_of(largest: float, d: int) -> str:
    """How sums of d products of components up to ``largest`` (before scaling) are held."""
    most = (256 * int(largest) + 257) ** 2 * d
    return "double" if most < 1 << 53 else "long" if most < 1 << 62 else "big"


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows with all rows: 64-bit or Python's integers, exactly."""
    out = q @ c.T
    return out.astype(np.int64) if out.dtype == np.float64 else out


def totals(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows in pairs."""
    out = (q * c).sum(axis=1)
    return out.astype(np.int64) if out.dtype == np.float64 else out


def sortable(v: int) -> bytes:
    """Bytes that sort as the integers do: a head that tells sign and length, then the number or its complement."""
    n = (abs(v).bit_length() + 7) // 8
    return (0x8000 + n).to_bytes(2, "big") + v.to_bytes(n, "big") if v >= 0 else (0x8000 - n).to_bytes(2, "big") + (256**n + v).to_bytes(n, "big")


def unsorted(data: bytes) -> int:
    n = int.from_bytes(data[:2], "big") - 0x8000
    return int.from_bytes(data[2:], "big") - (256**-n if n < 0 else 0)


def _column(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([sortable(int(v)) for v in values], pa.binary()) if kind == "big" else pa.array(values.astype(np.int64), pa.int64())


# ---------------------------------------------------------------- lists


def list_cuts(d: int, lists: int) -> list[slice]:
    edges = [d * i // lists for i in range(lists + 1)]
    return [slice(a, z) for a, z in zip(edges[:-1], edges[1:], strict=True) if z > a]


def best_entries(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest entries; ``own`` marks pairs that don't count."""
    if score.dtype == object:
        masked = np.where(own, -np.inf, score)
        at = np.argsort(-masked, axis=1, kind="stable")[:, :k]
    else:
        at = np.argpartition(-np.where(own, -_MOST, score), min(k, score.shape[1]) - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(score)), at.shape[1])
    column = at.ravel()
    good = ~own[row, column]
    return row[good], column[good]


def reaching(q: np.ndarray, x: np.ndarray, cuts: Sequence[slice], share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: the pairs (row of q, row of x) whose entry in some list is at least the query's share of the cutoff."""
    enough = np.zeros((len(q), len(x)), bool)
    for c in cuts:
        enough |= (products(q[:, c], x[:, c]) >= share[:, None]).astype(bool)
    return np.nonzero(enough)


def best_ids(row: np.ndarray, ids: np.ndarray, total: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's k ids of the highest totals, the best one of each id, ties to the smaller id."""
    order = np.argsort(-total, kind="stable")
    order = order[np.lexsort((ids[order], row[order]))]  # by row and id, the best total of an id first
    row, ids, total = row[order], ids[order], total[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, total = row[once], ids[once], total[once]
    order = np.argsort(-total, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, ids, total = row[order], ids[order], total[order]
    some = np.arange(len(row)) - np.searchsorted(row, row) < k
    return [row[some], ids[some], total[some]]


# ---------------------------------------------------------------- search


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, block: int = QUERY_BLOCK) -> DataFrame:
    """For each row whose id is divisible by ``every``: the k highest integer scores among all other rows, exactly.

    (query_id long, rank int from 1, vec_id long, score long). Components are floor(256 * x). Rows with a null id, a null
    or empty vector or null or non-finite components take no part, nor vectors of another length than the most common
    one; zero vectors do. Rows with the query's own id are no candidates; of several rows of one id the best counts. Of
    several query rows of one id the one with the least vector asks. Ties go to the smaller id. A score that 64 bits
    can't hold is null, its rank is still exact. An empty table gives no rows; other columns are not read. Each block of
    queries is two passes over the table.
    """
    spark = embeddings.sparkSession
    arrow_rows(spark)
    known = embeddings.select(quoted(id_col).cast("long").alias("id"), F.transform(quoted(vector_col), lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    largest = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    sizes = known.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), largest.alias("largest")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], RESULT)
    if not sizes:
        return empty
    d, kind = sizes[0]["d"], kind_of(sizes[0]["largest"], sizes[0]["d"])
    known = known.where(F.size("v") == d)
    asking = settle(known.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    blocks = -(-asking.count() // max(1, min(block, BLOCK_BYTES // (8 * d))))
    if not blocks:
        return empty
    path = fresh_path(spark, "top-k")
    for i in range(blocks):
        found = _block(known, asking.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i), k, lists, kind)
        if found is not None:
            found.write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _block(known: DataFrame, asking: DataFrame, k: int, lists: int, kind: str) -> DataFrame | None:
    """The results of one block of queries; None if the block is empty."""
    spark = known.sparkSession
    got = asking.toArrow().sort_by("id")
    if not got.num_rows:
        return None

    def vectors(column: pa.Array) -> np.ndarray:
        return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), kind)

    q_ids, q = got["id"].to_numpy(), vectors(got["v"].combine_chunks())
    queries = spark.sparkContext.broadcast((q_ids, q))
    cuts = list_cuts(q.shape[1], lists)
    number = "binary" if kind == "big" else "long"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: the task's k best entries of each query and list, with the totals of these."""
        q_ids, q = queries.value
        best: list[list[np.ndarray] | None] = [None] * len(cuts)  # query, id, entry, total
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            x = vectors(b.column(1))
            own = q_ids[:, None] == ids[None, :]
            for i, c in enumerate(cuts):
                entries = products(q[:, c], x[:, c])
                row, column = best_entries(entries, own, k)
                here = [row, ids[column], entries[row, column], totals(q[row], x[column])]
                if best[i] is not None:
                    here = [np.concatenate(p) for p in zip(best[i], here, strict=True)]
                order = np.argsort(-here[2], kind="stable")
                order = order[np.argsort(here[0][order], kind="stable")]
                row = here[0][order]
                order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
                best[i] = [p[order] for p in here]
        for i, some in enumerate(best):
            if some is not None:
                row, ids, entry, total = some
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(np.full(len(row), i, np.int32)), pa.array(ids), _column(entry, kind), _column(total, kind)], names=["q", "list", "vec_id", "entry", "total"])

    gathered = known.mapInArrow(lean(gather), f"q int, list int, vec_id long, entry {number}, total {number}")
    highest = Window.partitionBy("q", "list").orderBy(F.desc("entry"), "vec_id")
    first = gathered.withColumn("_r", F.row_number().over(highest)).where(F.col("_r") <= k).groupBy("q", "vec_id").agg(F.max("total").alias("total"))
    by_total = Window.partitionBy("q").orderBy(F.desc("total"), "vec_id")
    kth = first.withColumn("_r", F.row_number().over(by_total)).where(F.col("_r") == k).select("q", "total").collect()
    # Without k others every total is enough; so is every entry.
    cutoff = np.full(len(q_ids), -np.inf, object) if kind == "big" else np.full(len(q_ids), _LEAST, np.int64)
    for r in kth:
        cutoff[r["q"]] = unsorted(bytes(r["total"])) if kind == "big" else r["total"]
    share = np.array([c if c in (-np.inf, _LEAST) else -(-int(c) // len(cuts)) for c in cutoff.tolist()], cutoff.dtype)
    safe = spark.sparkContext.broadcast((cutoff, share))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3: entries at the cutoff's share or more, then their totals; of these a task needs its k best."""
        q_ids, q = queries.value
        least, share = safe.value
        best: list[np.ndarray] | None = None  # query, id, total
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            x = vectors(b.column(1))
            row, column = reaching(q, x, cuts, share)
            other = q_ids[row] != ids[column]
            row, column = row[other], column[other]
            total = totals(q[row], x[column])
            good = (total >= least[row]).astype(bool)
            here = [row[good], ids[column[good]], total[good]]
            best = best_ids(*(here if best is None else (np.concatenate(p) for p in zip(best, here, strict=True))), k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[1]), _column(best[2], kind)], names=["query_id", "vec_id", "score"])

    found = known.mapInArrow(lean(resolve), f"query_id long, vec_id long, score {number}")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out if kind != "big" else out.mapInArrow(_narrow, RESULT)


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = [unsorted(s) for s in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([s if _LEAST <= s <= _MOST else None for s in scores], pa.int64())], names=["query_id", "rank", "vec_id", "score"])
