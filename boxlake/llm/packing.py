"""Best-fit packing into bins of several permitted sequence lengths.

Only the histogram of lengths (at most the largest permitted length) reaches the driver. Best-fit decreasing is run on
it in bulk: a whole run of equal lengths goes into a whole group of equally filled bins at once, so the work there
doesn't grow with the data and the packing is the global one, not one per partition. The plan is a table of intervals:
items are ranked within their length by a distributed prefix sum and look their bin up in it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import lean, quoted, running_offsets, settle
from boxlake.llm.token_counts import token_counts

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs beside its tokens, in tokens.
OVERHEAD = 16


@dataclass
class Plan:
    """``items``: rows (length, first rank, items a bin, first bin, first offset); ``bins``: rows (first bin, number, filled, capacity)."""

    items: np.ndarray
    bins: np.ndarray
    cost: int


def _best_fit(counts: Sequence[tuple[int, int]], capacities: Sequence[int], overhead: int, only: int | None) -> Plan:
    items, free, residuals, next_bin = [], {}, [], 0  # free: residual -> groups (first bin, number, filled)

    def put(residual: int, group: tuple[int, int, int]) -> None:
        if residual not in free:
            insort(residuals, residual)
            free[residual] = []
        free[residual].append(group)

    def place(length: int, rank: int, left: int, residual: int, group: tuple[int, int, int]) -> int:
        """Fill bins of the group with as many of the items as go in; the rest of the group stays open."""
        first, number, filled = group
        each = residual // length
        full = min(number, left // each)
        if full:
            items.append((length, rank, each, first, filled))
            put(residual - each * length, (first, full, filled + each * length))
            if full < number:
                put(residual, (first + full, number - full, filled))
            return full * each
        items.append((length, rank, left, first, filled))
        put(residual - left * length, (first, 1, filled + left * length))
        if number > 1:
            put(residual, (first + 1, number - 1, filled))
        return left

    for length, count in sorted(counts, reverse=True):
        rank = 0
        while rank < count:
            at = bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                group = free[residual].pop()
                if not free[residual]:
                    del free[residual], residuals[at]
            else:  # open bins of the size that costs least for each token it takes
                left = count - rank
                residual = only or min((c for c in capacities if c >= length), key=lambda c: ((c + overhead) / (min(c // length, left) * length), c))
                group = (next_bin, -(-left // (residual // length)), 0)
                next_bin += group[1]
            rank += place(length, rank, count - rank, residual, group)
    sizes, bins = np.array(sorted(capacities)), []
    for groups in free.values():
        for first, number, filled in groups:
            bins.append((first, number, filled, int(sizes[np.searchsorted(sizes, filled)])))  # downsized to its contents
    table = lambda rows, width: np.array(sorted(rows), np.int64).reshape(-1, width)
    return Plan(table(items, 5), table(bins, 4), sum(n * (c + overhead) for _, n, _, c in bins))


def plan_bins(counts: Sequence[tuple[int, int]], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """The cheapest of: opening the least-cost size each time, and always opening one of the sizes that hold all lengths."""
    longest = max((x for x, _ in counts), default=0)
    return min((_best_fit(counts, capacities, overhead, c) for c in (None, *(c for c in capacities if c >= longest))), key=lambda p: p.cost)


def pack(lengths: DataFrame, id_col: str, length_col: str, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Pack rows of (id, length): (id, piece int, start long, n_tokens long, bin_id long, bin_capacity int, bin_offset int).

    A row longer than the largest capacity is cut in pieces of that length and a rest; ``start`` is the piece's place in
    its row, ``bin_offset`` its place in its bin. Every token is packed once. A null or zero length gives one row with
    no bin. Repeated rows and ids, null ids among them, are packed each for itself (which of equal rows goes where is
    immaterial). An empty table gives no rows. Sorted by (length, id, piece), so reruns agree.
    """
    most = max(capacities)
    kind = lengths.schema[id_col].dataType.simpleString()
    rows = lengths.select(quoted(id_col).alias("id"), F.coalesce(quoted(length_col).cast("long"), F.lit(0)).alias("n"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1))).alias("piece")
    cut = rows.select("id", "n", piece).select("id", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece").cast("long") * most).alias("n_tokens"))
    cut = settle(cut)
    ranked = running_offsets(cut.withColumn("one", F.lit(1).cast("long")), "n_tokens", ["id", "piece", "start"], "one", "rank")
    counts = [(r["n_tokens"], r["n"]) for r in cut.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()]
    plan = plan_bins(counts, capacities, overhead)
    shared = lengths.sparkSession.sparkContext.broadcast((plan.items, plan.bins))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, bins = shared.value
        keys = items[:, 0] << 44 | items[:, 1]
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            none = n == 0
            if len(items):
                at = np.maximum(np.searchsorted(keys, n << 44 | rank, "right") - 1, 0)
                step = rank - items[at, 1]
                name = items[at, 3] + step // items[at, 2]
                offset = items[at, 4] + step % items[at, 2] * n
                size = bins[np.maximum(np.searchsorted(bins[:, 0], name, "right") - 1, 0), 3]
            else:
                name = offset = size = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(name, pa.int64(), mask=none), pa.array(size.astype(np.int32), pa.int32(), mask=none), pa.array(offset.astype(np.int32), pa.int32(), mask=none)], names=["id", "piece", "start", "n_tokens", "bin_id", "bin_capacity", "bin_offset"])

    out = ranked.select("id", "piece", "start", "n_tokens", "rank").mapInArrow(lean(assign), f"id {kind}, piece int, start long, n_tokens long, bin_id long, bin_capacity int, bin_offset int")
    return out.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """Count the tokens of every whole text and pack the documents; see pack()."""
    counted = token_counts(docs, tokenizer_path, id_col, text_col).select(id_col, "n_tokens")
    return pack(counted, id_col, "n_tokens", capacities)
