"""Live interleaving: chunks under the session's falling bound, and the gate that writes them in order.

State is a small record a track and the times of queued chunks; payloads stay in the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boxlake.functions.time import UNITS
from boxlake.operators.mux import CHUNK_BYTES, Interleaver

CHUNK = ["track", "chunk", "first", "n", "bytes", "t_start", "t_end", "bound"]


def interleave_stream(samples: DataFrame, bytes_most: int = CHUNK_BYTES, time_most: int = UNITS) -> DataFrame:
    """Closed chunks (session, track, chunk, first, n, bytes, t_start, t_end, bound) of a stream (session, track, arrival,
    sample, t, stop, size, frame, last): as the batch operator has them.

    Samples of a session come in order of ``arrival`` within a batch or later batches. A row with ``last`` ends the whole
    session: its open chunks are closed as they stand.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bound, chunks, rates = json.loads(state.get[0]) if state.exists else (None, [], [])
        open_ = Interleaver(bytes_most, time_most, bound, dict(chunks), dict(rates))
        rows, made = pd.concat(list(batches)).sort_values(["arrival", "track", "sample"]), []
        for r in rows.itertuples():
            stop = int(r.t) + 1 if pd.isna(r.stop) else int(r.stop)
            closed = open_.add(int(r.track), int(r.sample), int(r.t), stop, 0 if pd.isna(r.size) else int(r.size), None if pd.isna(r.frame) else int(r.frame))
            if closed:
                made.append(closed)
        if rows["last"].any():
            made += open_.rest()
            open_ = Interleaver(bytes_most, time_most)
        state.update((json.dumps([open_.bound, list(open_.chunks.items()), list(open_.rates.items())]),))
        out = pd.DataFrame(made, columns=CHUNK).astype("int64")
        out.insert(0, "session", key[0])
        yield out

    return samples.groupBy("session").applyInPandasWithState(fold, "session long, " + ", ".join(f"{c} long" for c in CHUNK), "state string", "append", GroupStateTimeout.NoTimeout)


class Gate:
    """Which queued chunk may be written: the earliest head, while every track has one or is at its end.

    Once some track is at its end with nothing queued the others don't wait for each other any more. A flushed track
    loses what is queued and takes no more.
    """

    def __init__(self, queues: dict | None = None, ended: set | None = None, flushed: set | None = None, place: int = 0):
        self.queues: dict[int, list] = queues or {}  # track: chunks (start, chunk)
        self.ended, self.flushed, self.place = ended or set(), flushed or set(), place

    def add(self, track: int, start: int | None = None, chunk: int | None = None, ends: bool = False, flush: bool = False) -> None:
        queue = self.queues.setdefault(track, [])
        if flush:
            queue.clear()
            self.flushed.add(track)
            self.ended.add(track)
        elif start is not None and track not in self.flushed:
            queue.append([start, chunk])
        if ends:
            self.ended.add(track)

    def ready(self, stopping: bool = False) -> Iterator[tuple[int, int, int, int]]:
        """(track, chunk, start, place) of chunks that may be written now; all that are queued, when stopping."""
        while True:
            heads = [(q[0][0], t) for t, q in self.queues.items() if q]
            empty = [t for t, q in self.queues.items() if not q]
            waits = any(t not in self.ended for t in empty) and not any(t in self.ended for t in empty)
            if not heads or (waits and not stopping):
                return
            start, track = min(heads)
            yield track, self.queues[track].pop(0)[1], start, self.place
            self.place += 1

    def finished(self) -> bool:
        """All tracks are at their end and nothing is queued."""
        return all(not q and t in self.ended for t, q in self.queues.items())


def gate_stream(chunks: DataFrame) -> DataFrame:
    """Chunks in the order in which they may be written: (session, track, chunk, t_start, place).

    A stream (session, tracks, seq, track, chunk, t_start, event): ``tracks`` is the number of the session's tracks (from 0),
    ``seq`` orders rows within a session, ``event`` is null for a chunk, "end" (of the track, with its last chunk if chunk
    is set), "flush" (of the track) or "stop" (of the session: what is queued is drained in merge order).
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queues, ended, flushed, place = json.loads(state.get[0]) if state.exists else ([], [], [], 0)
        gate = Gate(dict(queues), set(ended), set(flushed), place)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            for t in range(int(r.tracks)):
                gate.queues.setdefault(t, [])
            if r.event != "stop":
                gate.add(int(r.track), None if pd.isna(r.t_start) else int(r.t_start), None if pd.isna(r.chunk) else int(r.chunk), r.event == "end", r.event == "flush")
            out += gate.ready(r.event == "stop")
        state.update((json.dumps([list(gate.queues.items()), sorted(gate.ended), sorted(gate.flushed), gate.place]),))
        made = pd.DataFrame(out, columns=["track", "chunk", "t_start", "place"]).astype("int64")
        made.insert(0, "session", key[0])
        yield made

    return chunks.groupBy("session").applyInPandasWithState(fold, "session long, track long, chunk long, t_start long, place long", "state string", "append", GroupStateTimeout.NoTimeout)
