"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are projected on a few random directions, shifted, put on a grid and ordered along a Hilbert curve, several times
over with other directions and shifts. Each ordering is cut in key ranges of about RANGE_ROWS rows; a query looks at its
own range and some on both sides. What the orderings find is scored exactly on the original vectors, merged and ranked.

How many orderings and how many ranges a query looks at is measured, not assumed: a fixed number of queries is searched
by brute force (one pass over the table), and of all pairs of numbers that find the wanted share of their true neighbours
the one with the least work is taken. On vectors with structure that is a few ranges whatever the size of the table; on
vectors without any no index can do with less than a constant share of the table, and the search then becomes the whole
one: it never costs more than that.

For inner products of vectors of different lengths, one coordinate is added that makes all candidates equally long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_rows, lean, quoted, settle

ORDERINGS, PROJECTED, GRID_BITS = 24, 8, 7
#: Candidates of a key range and queries of one task's block, about; ranges at most (larger ones are dealt in parts).
RANGE_ROWS, QUERY_ROWS, MOST_RANGES = 8192, 8192, 8192
#: Vectors that the ranges are fitted on and bytes that they have, at most.
SAMPLE, SAMPLE_BYTES = 1 << 16, 1 << 26
#: Queries that are searched by brute force, and the share of their neighbours that has to be found.
MEASURED, WANTED = 128, 0.95
#: What moving a row costs, in pairs of vectors that are compared.
MOVE = 400


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (n, d), each coordinate of so many bits (d * bits <= 63).

    Coordinates are turned to the curve's transposed index by exchanging and inverting low bits from the top bit down,
    then Gray-decoded; the index's bits are read across the coordinates.
    """
    x = np.ascontiguousarray(grid.T).astype(np.int64)
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> level) & 1
    return key


@dataclass
class Curves:
    """Orderings with their key ranges; ``parts`` and ``blocks``: into how many parts a range's candidates and queries are dealt."""

    size: float
    longest: float
    directions: list[np.ndarray]
    centre: list[np.ndarray]
    spread: list[np.ndarray]
    edges: list[np.ndarray]
    parts: list[np.ndarray]
    blocks: list[np.ndarray]
    reach: int = 1

    def placed(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors of equal length: a coordinate more, in which queries and candidates differ."""
        if query:
            x = x / np.abs(x).max(axis=1, keepdims=True)
            return np.c_[x * (self.longest / np.sqrt(np.einsum("ij,ij->i", x, x)))[:, None], np.zeros(len(x))]
        x = x / self.size
        return np.c_[x, np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))]

    def keys(self, placed: np.ndarray, o: int) -> np.ndarray:
        y = (placed @ self.directions[o] - self.centre[o]) / self.spread[o]
        return hilbert_keys(np.clip((y + 2) / 4 * (1 << GRID_BITS), 0, (1 << GRID_BITS) - 1).astype(np.int64), GRID_BITS)

    def cells(self, placed: np.ndarray, o: int) -> np.ndarray:
        return np.searchsorted(self.edges[o], self.keys(placed, o), "right")


def fit_curves(sample: np.ndarray, rows: int, size: float, longest: float, orderings: int = ORDERINGS, range_rows: int = RANGE_ROWS, seed: int = 17) -> Curves:
    """Directions, shifts, key ranges of about equal numbers of rows, and in how many parts the rows of a range are dealt.

    ``size`` is the largest component of all, ``longest`` the length of the longest vector divided by it.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    d = sample.shape[1] + 1
    cells = max(1, min(-(-rows // range_rows), MOST_RANGES, len(sample) // 4))
    out = Curves(size, longest, [], [], [], [], [], [])
    placed = out.placed(sample, False)
    for o in range(orderings):
        out.directions.append(np.linalg.qr(random.normal(size=(d, d)))[0][:, : min(PROJECTED, d)])
        y = placed @ out.directions[o]
        out.spread.append(np.maximum(y.std(0), 1e-12))
        out.centre.append(y.mean(0) + random.uniform(-0.3, 0.3, y.shape[1]) * out.spread[o])
        keys = np.sort(out.keys(placed, o))
        out.edges.append(np.unique(keys[(np.arange(1, cells) * len(keys)) // cells]))
        share = np.bincount(np.searchsorted(out.edges[o], keys, "right"), minlength=len(out.edges[o]) + 1) / len(keys)
        out.parts.append(np.maximum(1, np.ceil(share * rows / (1.5 * range_rows)).astype(np.int64)))
    return out


def choose(own: np.ndarray, theirs: np.ndarray, cells: int, rows: int, queries: int, range_rows: int, wanted: float = WANTED) -> tuple[int, int]:
    """Orderings and ranges on each side with the least work that find the ``wanted`` share of true neighbours.

    ``own`` and ``theirs`` are the ranges of queries and their neighbours, (pairs, orderings).
    """
    apart = np.minimum.accumulate(np.abs(own - theirs), axis=1)
    best, cost = (1, cells), np.inf
    for o in range(1, apart.shape[1] + 1):
        reach = int(np.sort(apart[:, o - 1])[max(0, int(np.ceil(wanted * len(apart))) - 1)]) if len(apart) else cells
        looked = min(2 * reach + 1, cells)
        work = o * (MOVE * (rows + queries * looked) + queries * min(looked * range_rows, rows))
        if work < cost:
            best, cost = (o, reach), work
    return best


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def pick(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query (all ties in order of id): query ids, ids, scores.

    Scores that count are sums in one fixed order, whatever else is in the block, so equal vectors have equal scores. A
    score that no double holds is infinite or, without a sign, the least.
    """
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], c[order]
    out: tuple[list, list, list] = ([], [], [])
    for a in range(0, len(q), 256):
        with np.errstate(all="ignore"):
            rough = np.nan_to_num(q[a : a + 256] @ c.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        n = min(k, len(ids))
        least = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
        with np.errstate(all="ignore"):
            large = np.sqrt(np.einsum("ij,ij->i", q[a : a + 256], q[a : a + 256]) * np.einsum("ij,ij->i", c, c).max(initial=0))
            slack = np.where(np.isfinite(least) & np.isfinite(large), least - 1e-12 * large, -np.inf)
        for i in range(len(rough)):
            at = np.flatnonzero(rough[i] >= slack[i])
            with np.errstate(all="ignore"):
                exact = np.nan_to_num((c[at] * q[a + i]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            best = np.lexsort((ids[at], -exact))[:k]
            out[0].append(np.full(len(best), query_ids[a + i]))
            out[1].append(ids[at[best]])
            out[2].append(exact[best])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


RESULT = "query_id long, vec_id long, score double"


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", orderings: int = ORDERINGS, range_rows: int = RANGE_ROWS, wanted: float = WANTED) -> DataFrame:
    """The k nearest (largest inner product) found for each row whose id is divisible by ``every``, among all other rows.

    (query_id long, rank int from 1, vec_id long, score double). Rows with a null id, a null vector, a zero vector or
    null or non-finite components take no part, nor vectors of another length than the most common one. Rows with the
    query's own id are no candidates; of several rows of another id the best counts. Ties go to the smaller id. An empty
    table gives no rows; other columns are not read.

    Of equal vectors only the k + 1 least ids can be among a query's k nearest, so only these are indexed, and equal
    queries are searched once: a vector that a third of the rows share costs no more than another. Ranges are fitted on
    SAMPLE vectors at most, all are indexed. A range that holds far more than its share (near copies) is dealt over
    several tasks, and so are its queries.
    """
    spark = embeddings.sparkSession
    arrow_rows(spark)
    known = embeddings.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    wide = F.transform("v", lambda x: x.cast("double"))
    largest = F.max(F.greatest(F.array_max(wide), -F.array_min(wide)))
    stats = known.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), largest.alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not stats:
        return empty
    d, size = stats[0]["d"], float(stats[0]["m"])
    once = settle(known.where(F.size("v") == d).groupBy("v", "id").agg(F.count("*").alias("_n")).select("id", "v"))
    least = Window.partitionBy("v").orderBy("id")
    candidates = settle(once.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k + 1).select("id", "v"))
    asking = once.where(F.col("id") % every == 0)
    asked = settle(asking.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))  # one row a vector that asks, under its least id
    square = F.aggregate(wide, F.lit(0.0), lambda s, x: s + (x / size) * (x / size))
    whole = candidates.agg(F.count("*").alias("n"), F.max(square).alias("m")).first()
    n, n_asked = whole["n"], asked.count()
    if not n_asked:
        return empty

    most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    flat = _vectors(_some(candidates, n, most, 1).select("v").toArrow()["v"].combine_chunks(), d)
    curves = fit_curves(flat, n, size, float(whole["m"]) ** 0.5, orderings, range_rows)
    cells = max(len(e) for e in curves.edges) + 1
    own, theirs = _measured(candidates, _some(asked, n_asked, MEASURED, 2), curves, d, k) if cells > 1 else (np.zeros((0, 1)),) * 2
    used, curves.reach = choose(own, theirs, cells, n, n_asked, range_rows, wanted) if cells > 1 else (1, 0)
    sample = curves.placed(_vectors(_some(asked, n_asked, most, 3).select("v").toArrow()["v"].combine_chunks(), d), True)
    for o in range(used):
        here = np.bincount(curves.cells(sample, o), minlength=len(curves.edges[o]) + 1) * (n_asked / max(1, len(sample)))
        looked = np.convolve(here, np.ones(2 * curves.reach + 1))[curves.reach : curves.reach + len(here)] if 2 * curves.reach + 1 < len(here) else np.full(len(here), here.sum())
        curves.blocks.append(np.maximum(1, np.ceil(looked / QUERY_ROWS).astype(np.int64)))
    found = _searched(candidates, asked, curves, used, "float32" if dict(embeddings.select(quoted(vector_col).alias("v")).dtypes)["v"] == "array<float>" else "float64", k)

    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = merged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")
    named = asking.join(asked.select(F.col("id").alias("_under"), "v"), "v").select(F.col("id").alias("_asks"), "_under")
    each = named.join(merged, F.col("_under") == F.col("query_id")).where("_asks <> vec_id").groupBy(F.col("_asks").alias("query_id"), "vec_id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _some(rows: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """About ``most`` of n different rows, chosen by a hash of the row; all, if there are fewer."""
    if n <= most:
        return rows
    return rows.where(F.xxhash64("id", "v", F.lit(salt)).bitwiseAND((1 << 40) - 1) < (most << 40) // n)


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, d)


def _measured(candidates: DataFrame, some: DataFrame, curves: Curves, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of a few queries and of their true neighbours in every ordering: one pass over all candidates."""
    spark = candidates.sparkSession
    got = some.toArrow()
    shared = spark.sparkContext.broadcast((got["id"].to_numpy(), _vectors(got["v"].combine_chunks(), d)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        held: tuple[np.ndarray, np.ndarray] | None = None
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _vectors(b.column(1), d)
            if held is not None:
                ids, x = np.concatenate([held[0], ids]), np.concatenate([held[1], x])
            out = pick(q_ids, q, ids, x, k + 1)
            row = np.flatnonzero(np.isin(ids, out[1]))
            held = ids[row], x[row]  # what no query has among its best can go
        if out is not None:
            at = np.argsort(held[0], kind="stable")
            place = at[np.searchsorted(held[0][at], out[1])]
            yield pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2]), pa.array([r.tobytes() for r in held[1][place]], pa.binary())], names=["query_id", "vec_id", "score", "x"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = candidates.mapInArrow(lean(search), "query_id long, vec_id long, score double, x binary").where("query_id <> vec_id")
    true = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("query_id", "x").toArrow()
    q_ids, q = shared.value
    if not true.num_rows:
        return np.zeros((0, len(curves.edges))), np.zeros((0, len(curves.edges)))
    x = curves.placed(np.frombuffer(b"".join(true["x"].to_pylist())).reshape(-1, d), False)
    order = np.argsort(q_ids)
    at = order[np.searchsorted(q_ids[order], true["query_id"].to_numpy())]
    asks = curves.placed(q, True)
    own = np.stack([curves.cells(asks, o)[at] for o in range(len(curves.edges))], 1)
    return own, np.stack([curves.cells(x, o) for o in range(len(curves.edges))], 1)


def _searched(candidates: DataFrame, asked: DataFrame, curves: Curves, used: int, kind: str, k: int) -> DataFrame:
    """(query_id, vec_id, score): what each query finds in the ranges it looks at, the k + 1 best of each task."""
    shared = candidates.sparkSession.sparkContext.broadcast(curves)

    def deal(query: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                ids = b.column(0).to_numpy()
                if not len(ids):
                    continue
                x = b.column(1).flatten().to_numpy().reshape(len(ids), -1)
                raw = np.array([r.tobytes() for r in x.astype(kind)], object)
                placed = c.placed(x.astype(np.float64), query)
                for o in range(used):
                    cell, row = c.cells(placed, o), np.arange(len(ids))
                    if query:  # to all parts of the ranges it looks at, in one block of queries
                        lo, hi = np.maximum(cell - c.reach, 0), np.minimum(cell + c.reach, len(c.edges[o]))
                        row, cell = np.repeat(row, hi - lo + 1), _steps(lo, hi - lo + 1)
                        times = c.parts[o][cell]
                        part = _steps(np.zeros(len(times), np.int64), times)
                        row, cell = np.repeat(row, times), np.repeat(cell, times)
                        block = _spread(ids[row]) % c.blocks[o][cell]
                    else:  # in one part of its range, for all blocks of queries
                        part, times = _spread(ids) % c.parts[o][cell], c.blocks[o][cell]
                        block = _steps(np.zeros(len(times), np.int64), times)
                        row, cell, part = np.repeat(row, times), np.repeat(cell, times), np.repeat(part, times)
                    group = np.int64(o) << 54 | cell.astype(np.int64) << 40 | part << 20 | block
                    for a in range(0, len(row), 1 << 14):
                        z = a + (1 << 14)
                        yield pa.RecordBatch.from_arrays([pa.array(group[a:z]), pa.array(np.full(len(row[a:z]), query)), pa.array(ids[row[a:z]]), pa.array(raw[row[a:z]], pa.binary())], names=["g", "ask", "id", "v"])

        return lean(rows)

    def search(table: pa.Table) -> pa.Table:
        ids, ask = table["id"].to_numpy(), table["ask"].to_numpy(zero_copy_only=False)
        x = np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
        none = not ask.any() or ask.all()
        found = (np.zeros(0),) * 3 if none else pick(ids[ask], x[ask], ids[~ask], x[~ask], k + 1)
        return pa.table({"query_id": pa.array(found[0].astype(np.int64)), "vec_id": pa.array(found[1].astype(np.int64)), "score": pa.array(found[2].astype(np.float64))})

    schema = "g long, ask boolean, id long, v binary"
    dealt = candidates.mapInArrow(deal(False), schema).unionByName(asked.mapInArrow(deal(True), schema))
    return dealt.groupBy("g").applyInArrow(search, RESULT)


def _steps(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them) for each row, one after another."""
    total = np.cumsum(n)
    return np.repeat(first - (total - n), n) + np.arange(total[-1] if len(total) else 0)


def _spread(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
