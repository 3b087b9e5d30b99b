"""Any names of other columns, null ids, repeated rows and empty tables, against brute force, for what the pipeline calls."""

import re
from collections import Counter

import numpy as np
import pytest

WORD = r"[^\x20\x09-\x0D]+"
#: Names that the operators use within, and names that need quoting.
NAMES = ["_h", "_spans", "_size", "_id", "_hash", "_kept", "kept", "row", "_row", "number", "sized", "spans", "other", "key", "src", "block", "whole", "part", "at", "n", "h", "t", "x", "y", "node", "component", "component_id", "n_shingles", "print", "bands", "bits", "hub", "some", "predicted", "score", "held_out", "slot", "_c", "_n", "_p", "a.b", "with space"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(len(NAMES))) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    random = np.random.Generator(np.random.PCG64(41))
    texts = [" ".join(f"w{random.integers(0, 4000)}" for _ in range(random.integers(20, 200))) for _ in range(40)]
    out = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    out += [(100 + i, texts[i] + " tail", "s0") for i in range(10)]
    out += [(None, texts[3], "s1"), (None, texts[3], "s1"), (None, None, None), (5, texts[5], "s1"), (5, "", "s2"), (60, None, "s2"), (61, " \n", "s3"), (None, "", "s0")]
    return out


def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")


def test_stages_keep_columns_of_any_name(spark, rows):
    from boxlake.llm.mixing import mixed_documents, mixed_sizes
    from boxlake.llm.neardup import first_of_each, near_duplicates
    from boxlake.llm.packing import pack_documents
    from boxlake.llm.quality import keep_good, quality
    from boxlake.llm.secrets import redact, secret_spans
    from boxlake.llm.entry import tokenizer

    docs = frame(spark, rows).repartition(3)
    none = docs.where("doc_id = -1")
    path = tokenizer("byte_bpe_50k.json")

    got = keep_good(docs, labels(spark))
    assert got.schema == docs.schema
    good = Counter((r.doc_id, r.score >= 0.5) for r in quality(docs, labels(spark)).collect())
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: sum(c for (k, ok), c in good.items() if k == i and ok) for i, ok in good if ok})

    first = first_of_each(docs)
    kept = first.collect()
    assert first.schema == docs.schema and all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in kept)
    want = {r.doc_id for r in near_duplicates(docs).collect() if r.kept}
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter({i: 1 for i in want if i is not None})
    assert sum(r.doc_id is None for r in kept) == 4 and next(r.text for r in kept if r.doc_id == 5) == ""
    assert not {100 + i for i in range(10)} & want  # near copies of smaller ids

    clean = redact(docs)
    assert clean.schema == docs.schema and Counter(tuple(r) for r in clean.collect()) == Counter(tuple(r) for r in docs.collect())
    assert secret_spans(docs).count() == len(rows)

    taken = Counter((r.doc_id, r.size, r.taken) for r in mixed_sizes(docs).collect())
    mixed = mixed_documents(docs)
    assert mixed.schema == docs.schema
    out = Counter((r.doc_id, len(re.findall(WORD, r.text or ""))) for r in mixed.collect())
    want = Counter()
    for (i, size, n), count in taken.items():
        if n or not size:
            want[i, n] += count
    assert sum(out.values()) == sum(want.values()) and sum(n * c for (_, n), c in out.items()) == sum(n * c for (_, n), c in want.items())
    assert {k for k in out if k[0] not in (None, 5)} == {k for k in want if k[0] not in (None, 5)}
    assert Counter(tuple(r) for r in mixed.collect()) == Counter(tuple(r) for r in mixed_documents(docs.repartition(5)).collect())

    packed = pack_documents(docs, path).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _, _ in rows)

    for stage in (lambda d: keep_good(d, labels(spark)), first_of_each, redact, mixed_documents):
        assert stage(none).collect() == [] and stage(none).schema == docs.schema
    assert pack_documents(none, path).collect() == []


def test_words_of_the_mix_are_the_documents_words(spark, rows):
    """Each text of the mix is made of whole takes of its own words, in order, and at most one cut take of each segment."""
    from boxlake.llm.mixing import mixed_documents, mixed_sizes

    own = [(i, t, s) for i, t, s in rows if i is not None and i != 5]
    docs = frame(spark, own)
    before = {i: re.findall(WORD, t or "") for i, t, _ in own}
    sizes = {r.doc_id: r for r in mixed_sizes(docs).collect()}
    for r in mixed_documents(docs).collect():
        words = re.findall(WORD, r.text or "")
        assert len(words) == sizes[r.doc_id].taken
        assert max(Counter(words).values(), default=0) <= 3 * max(Counter(before[r.doc_id]).values(), default=0)
        assert not Counter(words) - Counter(before[r.doc_id] * 3)
        if words and words == before[r.doc_id]:
            assert r.text == dict((i, t) for i, t, _ in own)[r.doc_id].rstrip() or r.text == dict((i, t) for i, t, _ in own)[r.doc_id]


def test_draws_at_any_number():
    from boxlake.llm.mixing import drawn, plan_sources, shard_counts

    random = np.random.Generator(np.random.PCG64(42))
    for counts in ([3, 0, 5], [10**6, 5, 10**7], [10**15, 10**12, 7, 10**17]):
        counts = np.array(counts, np.int64)
        for share in (0, 0.001, 0.3, 0.5, 0.9, 1):
            take = int(int(counts.sum()) * share)
            got = drawn(random, counts, take)
            assert got.sum() == take and (got >= 0).all() and (got <= counts).all()
    counts, draws = np.array([30, 50, 20]), []
    for _ in range(4000):
        draws.append(drawn(random, counts, 40))
    mean, spread = np.mean(draws, 0), np.var(draws, 0)
    assert np.allclose(mean, 40 * counts / 100, atol=0.25)
    assert np.allclose(spread, 40 * counts / 100 * (1 - counts / 100) * 60 / 99, rtol=0.12)
    import boxlake.llm.mixing as mixing

    few, mixing._FEW = mixing._FEW, 4  # coins first, then what is missing
    try:
        draws = [drawn(random, counts, 40) for _ in range(4000)]
    finally:
        mixing._FEW = few
    assert np.allclose(np.mean(draws, 0), 40 * counts / 100, atol=0.25)
    assert np.allclose(np.var(draws, 0), 40 * counts / 100 * (1 - counts / 100) * 60 / 99, rtol=0.12)
    slots = np.array([4 * 10**11, 3 * 10**10, 5])
    k = next(shard_counts(slots, 4096, 1, 10**7, 10**7 + 1))
    assert k[0] == 10**7 and k[1].sum() == 4096
    many = plan_sources([(f"s{i:06}", i % 7) for i in range(200_000)], 7)
    assert len(many) == 200_000 and all(s.want <= 3 * s.size for s in many)


def test_more_sources_than_are_broadcast(spark):
    import boxlake.llm.mixing as mixing

    docs = spark.createDataFrame([(i, f"a{i} b c", f"s{i % 300}") for i in range(900)], "doc_id long, text string, source string")
    want = Counter(tuple(r) for r in mixing.mixed_sizes(docs).collect())
    most, mixing.BROADCAST_SOURCES = mixing.BROADCAST_SOURCES, 10
    try:
        assert Counter(tuple(r) for r in mixing.mixed_sizes(docs).collect()) == want
    finally:
        mixing.BROADCAST_SOURCES = most


def test_scores_do_not_depend_on_the_batch(spark):
    from boxlake.llm.quality import quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    once = {r.doc_id: r.score for r in quality(docs.repartition(1), marks).collect()}
    for n in (7, 64):
        assert {r.doc_id: r.score for r in quality(docs.repartition(n), marks).collect()} == once
