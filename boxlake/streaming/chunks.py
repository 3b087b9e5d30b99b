"""Live chunking: Structured Streaming with one state a track.

The state holds the open chunk's sums only. A chunk is emitted when a sample takes it over the bounds, or, for the end of
a stream, when a row with ``last`` set arrives. Rows of a track have to arrive in order of ``sample`` within a batch or
later batches; times may go back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "track long, chunk long, first long, n long, bytes long, t_start long, t_end long"
STATE = "chunk long, first long, n long, bytes long, t_start long, t_end long"


def chunk_stream(samples: DataFrame, bytes_most: int = 400 << 10, time_most: int = 10_000_000) -> DataFrame:
    """Closed chunks of a stream (track long, sample, t, stop, size, last boolean)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, first, n, size, start, end = state.get if state.exists else (0, 0, 0, 0, 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("sample", kind="stable")
        for r in rows.itertuples():
            stop = r.t + 1 if pd.isna(r.stop) else int(r.stop)
            if not n:
                first, start, end = r.sample, r.t, stop
            n, size, start, end = n + 1, size + int(r.size), min(start, r.t), max(end, stop)
            if size > bytes_most or end - start > time_most or r.last:
                out.append((key[0], number, first, n, size, start, end))
                number, n, size = number + 1, 0, 0
        state.update((int(number), int(first), int(n), int(size), int(start), int(end)))
        yield pd.DataFrame(out, columns=["track", "chunk", "first", "n", "bytes", "t_start", "t_end"]).astype("int64")

    return samples.groupBy("track").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def discard_stream(samples: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows of a stream within a range of time; preroll rows go."""
    kept = samples.where("not preroll") if "preroll" in samples.columns else samples
    return kept.where((kept["stop"] > start) & (kept["t"] < stop))
