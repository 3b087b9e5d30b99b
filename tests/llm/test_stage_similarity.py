"""The pipeline's near-duplicates stage links documents of a similarity of 0.8 or more."""

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_takes_four_fifths(spark):
    from corpus_pipeline import distinct_documents

    random = np.random.Generator(np.random.PCG64(80))
    rows, kept = [], set()
    for k in range(60):
        words = [f"u{k}x{random.integers(0, 10**6)}" for _ in range(204)]  # 200 shingles, of which each change makes 5 others
        changes = 4 if k % 2 else 5  # 180 of 220 are common (0.818), or 175 of 225 (0.778)
        other = list(words)
        for i in range(changes):
            other[20 + 40 * i] = f"new{k}x{i}"
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join(other), "en", "s", 1)]
        kept |= {2 * k} if changes == 4 else {2 * k, 2 * k + 1}
    got = distinct_documents(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)


def test_bands_of_the_stage():
    import corpus_pipeline as p

    assert (1 - (p.PERCENT / 100) ** p.ROWS) ** p.BANDS < 4e-6
