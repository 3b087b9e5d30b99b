"""The lookups for every sample, against brute force over runs and samples."""

from collections import defaultdict

from boxlake.operators import index
from boxlake.plans import contract

SF = "/root/testdata/sf0.001"


def by_track(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.track].append(r)
    return out


def test_time_to_sample(spark):
    runs = by_track(contract.tick_runs(spark, SF).collect())
    bounds = {}
    for track, rows in runs.items():
        t0 = s0 = 0
        bounds[track] = []
        for r in sorted(rows, key=lambda r: r.run):
            bounds[track].append((t0, s0, max(1, r.v * 10_000_000 // contract.SCALE)))
            t0, s0 = t0 + r.n * r.v * 10_000_000 // contract.SCALE, s0 + r.n
    want = []
    for r in contract.media(spark, SF).collect():
        t0, s0, step = [b for b in bounds[r.track] if b[0] <= r.t][-1]
        want.append((r.track, r.t, s0 + (r.t - t0) // step))
    got = contract.QUERIES["time_to_sample"](spark, SF).collect()
    assert sorted((r.track, r.t, r["sample"]) for r in got) == sorted(want)


def test_nearest_cover(spark):
    samples = by_track(index.sample_times(contract.tick_runs(spark, SF), contract.SCALE).collect())
    want = {}
    for r in contract.media(spark, SF).collect():
        hits = [s["sample"] for s in samples[r.track] if s.cts >= 0 and s.dur > 0 and r.t < s.cts + s.dur]
        want[r.track, r.t] = min(hits, default=-1)
    got = contract.QUERIES["nearest_cover"](spark, SF).collect()
    assert sorted((r.track, r.t, r["sample"]) for r in got) == sorted((*k, v) for k, v in want.items())
