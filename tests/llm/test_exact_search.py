"""Exact search on large numbers, and what its threshold saves."""

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<double>, rank int, score string, `a.b` int"


def brute(x, every, k):
    whole = [[(256 * v.as_integer_ratio()[0]) // v.as_integer_ratio()[1] for v in map(float, row)] for row in x]
    out = {}
    for q in range(0, len(whole), every):
        scores = [(-sum(a * b for a, b in zip(whole[q], row, strict=True)), i) for i, row in enumerate(whole) if i != q]
        for r, (s, i) in enumerate(sorted(scores)[:k]):
            out[q, r + 1] = i, -s
    return out


def found(spark, x, **options):
    from boxlake.llm.topk import top_k

    df = spark.createDataFrame([(i, [float(v) for v in row], 1, "s", 2) for i, row in enumerate(x)], VECTORS).repartition(3)
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(df, **options).collect()}


@pytest.mark.parametrize("size", [1.0, 1e5, 1e9, 1e30, 1e300])
def test_whole_numbers_of_any_size(spark, size):
    random = np.random.Generator(np.random.PCG64(31))
    x = random.normal(size=(60, 7)) * size
    x[10:30] = x[3]
    x[40] *= 1e-200
    want = brute(x, 10, 5)
    fits = {at: (i, s if -(1 << 63) <= s < 1 << 63 else None) for at, (i, s) in want.items()}
    assert found(spark, x, every=10, lists=3, block=2) == fits


def test_sums_that_no_double_holds(spark):
    big = 2.0**30
    got = found(spark, [[big, big], [big, 1 - big]])
    assert got == {(0, 1): (1, 70_368_744_177_664)}
    got = found(spark, [[2.0**22, 1 / 256], *([2.0**22, (2 * i + 1) / 256] for i in range(1, 8))])
    assert [got[0, r][0] for r in range(1, 6)] == [7, 6, 5, 4, 3]
    assert len({s for _, s in got.values()}) == 5


def test_bytes_sort_as_their_numbers():
    from boxlake.llm.topk import sortable, unsorted

    numbers = sorted({s * (1 << e) + d for e in (0, 7, 8, 16, 63, 64, 2000) for s in (-1, 0, 1) for d in (-1, 0, 1)})
    assert sorted(numbers, key=sortable) == numbers and [unsorted(sortable(v)) for v in numbers] == numbers


def test_the_cutoff_saves_totals():
    """Of all pairs only few have an entry that reaches the cutoff's share, and they hold all of the answer."""
    from boxlake.llm.topk import list_cuts, products, reaching

    random = np.random.Generator(np.random.PCG64(32))
    x = np.floor(256 * random.normal(size=(5000, 64)))
    q = x[:40]
    score = products(q, x)
    score[np.arange(40), np.arange(40)] = -(1 << 62)
    cutoff = -np.sort(-score, axis=1)[:, 4]
    row, column = reaching(q, x, list_cuts(64, 2), -(-cutoff // 2))
    assert len(row) < 0.03 * score.size
    pairs = set(zip(row.tolist(), column.tolist(), strict=True))
    assert all((i, int(j)) in pairs for i in range(40) for j in np.argsort(-score[i], kind="stable")[:5])


def test_repeated_ids_and_ties(spark):
    from boxlake.llm.topk import top_k

    rows = [(i % 20, [1.0, 2.0], 1, "s", 2) for i in range(400)] + [(0, [5.0, 5.0], 1, "s", 2), (7, [3.0, 3.0], 1, "s", 2)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, VECTORS).repartition(4), every=10).collect())
    same, high = 5 * 65536, 9 * 65536
    assert got == [(0, 1, 7, high), *((0, r, i, same) for r, i in ((2, 1), (3, 2), (4, 3), (5, 4))), (10, 1, 0, 15 * 65536), (10, 2, 7, high), *((10, r, i, same) for r, i in ((3, 1), (4, 2), (5, 3)))]
