"""Nearest neighbours among vectors of very large, very small and denormal components, zeros and non-finite ones."""

import math

import numpy as np


def test_norms_of_any_size(spark):
    from boxlake.llm.ann import nearest

    random = np.random.Generator(np.random.PCG64(9))
    x = random.standard_normal((200, 8))
    for i, size in enumerate((1e150, 1e-310, 1e-160, 1e100, 1e-200)):
        x[10 * i : 10 * i + 10] *= size
    x[60:70], x[80:100], x[70, 0], x[71, 0] = 0, x[100], np.inf, np.nan
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    good = [i for i in range(200) if np.isfinite(x[i]).all() and x[i].any()]
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        score = {i: math.fsum(a * b for a, b in zip(x[q], x[i], strict=True)) for i in good if i != q}
        assert sorted(found) == list(range(1, 21))
        least = sorted(score.values(), reverse=True)[19]
        size = {i: float(np.abs(x[q] * x[i]).sum()) for i in score}
        for rank in range(1, 21):
            i, s = found[rank]
            assert abs(s - score[i]) <= 1e-14 * size[i] and s >= least - 1e-14 * size[i]
            if rank > 1:
                assert (-found[rank - 1][1], found[rank - 1][0]) < (-s, i)
