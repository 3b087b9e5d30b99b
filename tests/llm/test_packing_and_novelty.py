"""Packing of several sizes against one item at a time, its query, and what novelty finds of planted secrets."""

from collections import Counter

import numpy as np
import pytest


def one_at_a_time(lengths, capacities, overhead, only):
    """Best fit decreasing, item by item: [capacity when opened, free]; a new bin is of the size that costs least for its tokens."""
    bins, left = [], Counter(lengths)
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[1] >= x]
        if fit:
            min(fit, key=lambda b: b[1])[1] -= x
        else:
            size = only or min((c for c in capacities if c >= x), key=lambda c: ((c + overhead) / (min(c // x, left[x]) * x), c))
            bins.append([size, size - x])
        left[x] -= 1
    filled = [size - free for size, free in bins]
    return filled, sum(min(c for c in capacities if c >= f) + overhead for f in filled)


def test_several_sizes_as_one_item_at_a_time():
    from boxlake.llm.packing import _best_fit, plan_bins

    random = np.random.Generator(np.random.PCG64(51))
    capacities, overhead = (40, 100, 250), 7
    for _ in range(25):
        lengths = random.integers(1, 250, random.integers(1, 150)).tolist()
        counts = sorted(Counter(lengths).items())
        # With one size open the bulk plan is best fit itself.
        for only in (250,):
            plan = _best_fit(counts, capacities, overhead, only)
            filled, cost = one_at_a_time(lengths, capacities, overhead, only)
            assert sorted(f for _, n, f, _ in plan.bins.tolist() for _ in range(n)) == sorted(filled) and plan.cost == cost
        plan = plan_bins(counts, capacities, overhead)
        costs = [_best_fit(counts, capacities, overhead, only).cost for only in (None, *(c for c in capacities if c >= max(lengths)))]
        assert plan.cost == min(costs) and plan.cost <= one_at_a_time(lengths, capacities, overhead, 250)[1]
        assert sum(n * f for _, n, f, _ in plan.bins.tolist()) == sum(lengths)
        assert all(c == min(k for k in capacities if k >= f) for _, _, f, c in plan.bins.tolist())


def test_packing_query(spark):
    from boxlake.llm.entry import op1_token_counts, op2_best_fit_packing

    sf = "/root/testdata/sf0.001"
    counts = {r.doc_id: r.n_tokens for r in op1_token_counts(spark, sf).collect()}
    got = op2_best_fit_packing(spark, sf).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == counts
    own = got[got.n_tokens > 0]
    for _, g in own.groupby("bin_id"):
        g = g.sort_values("bin_offset")
        assert g.bin_offset.tolist() == (g.n_tokens.cumsum() - g.n_tokens).tolist()
        assert g.bin_capacity.nunique() == 1 and g.n_tokens.sum() <= g.bin_capacity.iloc[0]


@pytest.fixture(scope="module")
def prose():
    import pandas as pd

    return [t for t in pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.dropna() if len(t) > 200][:60]


def test_planted_secrets_are_found_and_prose_is_left_alone(prose):
    from boxlake.llm.secrets import scan

    random = np.random.Generator(np.random.PCG64(52))
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    found = clean = 0
    for i, text in enumerate(prose):
        key = "".join(random.choice(letters, random.integers(24, 60)))
        planted = text[:100] + f" the credential is {key} and " + text[100:]
        at = planted.index(key)
        found += any(k == "novel" and a <= at and z >= at + len(key) for k, a, z in scan(planted))
        # the same string where nothing is sensitive, and a long name in a sensitive place
        plain = text[:100] + f" the page is {key} and " + text[100:]
        name = text[:100] + " the key is environment_configuration_repository and " + text[100:]
        clean += not any(k == "novel" and "page is" in plain[max(0, a - 12) : a] for k, a, _ in scan(plain)) and not any(k == "novel" and "environment" in name[a:z] for k, a, z in scan(name))
    assert found >= 0.95 * len(prose) and clean >= 0.95 * len(prose)
