"""Near-duplicates by b-bit MinHash.

Every whole text becomes its set of word shingles. Minima of many hash functions give band keys for candidates and,
cut to their low bits and packed, a signature whose agreement (corrected for chance) estimates the similarity. Candidates
whose estimate is far below the threshold go; the rest are confirmed on the full sets.

Texts with equal sets are one node from the start. In a band's bucket no node is paired with all others: buckets whose
nodes are already one component need nothing, and in the others some nodes outside the largest component are compared
with the whole bucket and leave it, round by round, until no bucket holds two components. Every pair of a bucket that
could still join two components is thus looked at, without ever listing the pairs within a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_rows, free, lean, mixed, quoted, save, text_parts, unused, words

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, LOW_BITS = 40, 8, 8
#: A pair is looked at on full sets if its estimate is at least the threshold less this (about five standard errors).
SLACK = 0.1
#: Nodes of a bucket that are compared with all of it in the first round (twice as many in each further one), and rows of a part, about.
HUBS, PART = 256, 256
#: Bytes of shingle sets that a task keeps for further pairs.
KEPT_BYTES = 1 << 26


@cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What is xored and multiplied in each of n hash functions."""
    random = np.random.Generator(np.random.PCG64(85))
    return random.integers(0, 1 << 32, n, dtype=np.uint32), random.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles (all words as one, if there are fewer)."""
    h, first = words(buf, offsets)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = z - a
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        size = min(k, n)
        s = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[a + i : z - size + 1 + i]
        out.append(np.unique(mixed(s)))
    return out


def minima(s: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least value of each of n hash functions over a set."""
    xor, mul = _functions(n)
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(low), 2048):
        x = low[a : a + 2048, None] ^ xor
        x *= mul
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def signature(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, bytes]:
    """Band keys (64 bits, different for each band) and the packed low bits."""
    m = minima(s, bands * rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for row in m.reshape(bands, rows).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64), (m & np.uint32((1 << LOW_BITS) - 1)).astype(np.uint8).tobytes()


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from packed low bits (rows): the share of equal minima less what is equal by chance."""
    chance = 2.0**-LOW_BITS
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _packed_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Packed signatures, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _signed(docs: DataFrame, id_col: str, text_col: str, k: int, n_bands: int, n_rows: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, prints, keys, bits = [], [], [], []
            for _, _, buf, offsets in text_parts(b.column(1)):
                for s in shingle_sets(buf, offsets, k):
                    sizes.append(len(s))
                    if len(s):
                        band, packed = signature(s, n_bands, n_rows)
                        keys.append(band)
                        bits.append(packed)
                        with np.errstate(over="ignore"):
                            prints.append(np.array([s.sum(), mixed(s).sum()], np.uint64).tobytes() + len(s).to_bytes(8, "little"))
                    else:
                        keys.append(None)
                        bits.append(None)
                        prints.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["id", "n_shingles", "print", "bands", "bits"])

    return docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t")).mapInArrow(lean(sign), f"id {kind}, n_shingles long, print binary, bands array<long>, bits binary")


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, x, b, y) with signatures x and y: (a, b, estimate) where the estimate is not far below the threshold."""
    least = percent / 100 - SLACK
    kind = pairs.schema["a"].dataType.simpleString()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (_packed_rows(b.column(i)) for i in (2, 3))
            e = estimates(x, y)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(e)], names=["a", "b", "estimate"])
            yield out.filter(pa.array(e >= least))

    return pairs.select("a", "b", "x", "y").mapInArrow(lean(test), f"a {kind}, b {kind}, estimate double")


def _across(hubs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of a hub and a member of its bucket in different components, if the estimate lets them through.

    Both tables are (key, part, some, c, node, bits, bands). A pair that shares several buckets comes from the first of them
    only, so each comes once (twice, where both are hubs). The members of a bucket are dealt over parts and its hubs over
    blocks (``some``), both of bounded size, and every part meets every block. Signatures are compared within the task:
    pairs that fail are never rows.
    """
    least = percent / 100 - SLACK
    kind = members.schema["node"].dataType.simpleString()
    both = members.select("key", "part", "some", F.lit(False).alias("hub"), "c", "node", "bits", "bands").unionByName(hubs.select("key", "part", "some", F.lit(True).alias("hub"), "c", "node", "bits", "bands"))
    both = both.repartition("key", "part", "some").sortWithinPartitions("key", "part", "some")

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        hub = t["hub"].to_numpy()
        bits = _packed_rows(t["bits"])
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        key = t["key"][0].as_py()
        c, node, x, y = t["c"].to_numpy(), t["node"].to_numpy(), np.flatnonzero(hub), np.flatnonzero(~hub)
        found = []
        for a in range(0, len(x), 16):
            some = x[a : a + 16]
            for z in range(0, len(y), 512):
                other = y[z : z + 512]
                share = (bits[some, None, :] == bits[None, other, :]).mean(axis=2)
                i, j = np.nonzero(((share - 2.0**-LOW_BITS) / (1 - 2.0**-LOW_BITS) >= least) & (c[some, None] != c[None, other]))
                i, j = some[i], other[j]
                first = (bands[i] == bands[j]).argmax(axis=1)
                here = bands[i, first] == key
                found.append((node[i[here]], node[j[here]]))
        m, n = (np.concatenate([f[k] for f in found]) if found else node[:0] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(m, n)), pa.array(np.maximum(m, n))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for b in batches:
            key, part, some = (b.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (some[1:] != some[:-1])]) if len(key) else []
            for a, z in zip(starts, [*starts[1:], len(key)], strict=True):
                if held and (key[a], part[a], some[a]) != group:
                    yield pairs(held)
                    held = []
                group = key[a], part[a], some[a]
                held.append(b.slice(a, z - a))
        if held:
            yield pairs(held)

    return both.mapInArrow(lean(compare), f"a {kind}, b {kind}").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on the full sets of their whole texts."""
    kind = pairs.schema["a"].dataType.simpleString()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, str], np.ndarray] = {}
        size = 0
        for b in batches:
            good = []
            for a, z, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sets = []
                for name in ((a, x), (z, y)):
                    if name not in kept:
                        if size > KEPT_BYTES:
                            kept, size = {}, 0
                        raw = np.frombuffer(name[1].encode(), np.uint8)
                        kept[name] = shingle_sets(raw, np.array([0, len(raw)]), k)[0]
                        size += kept[name].nbytes + len(raw)
                    sets.append(kept[name])
                both = len(np.intersect1d(*sets, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(test), f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the least node that can be reached.

    Each round hooks every node to its least neighbour, follows the hooks to their ends, and goes on with the links
    between what is left; rounds grow with the logarithm of the links. Nothing is collected.
    """
    edges = save(links.select("a", "b").where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    total = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "hooks")
        while True:  # follow hooks
            further = hooks.alias("h").join(hooks.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("component") == F.col("_n"), "left")
            further = save(further.select(F.col("h.node").alias("node"), F.coalesce("_c", "component").alias("component"), (F.coalesce("_c", "component") != F.col("component")).alias("moved")), "hooks")
            done = further.where("moved").isEmpty()
            free(hooks)
            hooks = further
            if done:
                break
        if total is None:
            total = save(hooks.select("node", "component"), "components")
        else:
            further = save(total.join(hooks.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("node", F.coalesce("_c", "component").alias("component")), "components")
            free(total)
            total = further
        left = edges.join(hooks.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(hooks.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        further = save(left.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        free(edges, hooks)
        edges = further
        if edges.isEmpty():
            return total


def joined_components(component: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (a, b): only the components that these touch are worked on."""
    ends = component.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    by_a = links.join(ends, F.col("a") == F.col("_n"), "left").select(F.coalesce("_c", "a").alias("a"), "b")
    over = by_a.join(ends, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_c", "b").alias("b"))
    moved = components(over)
    known = component.join(moved.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
    out = save(known.unionByName(moved.join(component, "node", "left_anti").select("node", "component")), "components")
    free(component, moved)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Group near-duplicates: (id, n_shingles long, component_id, kept boolean), one row per input row.

    Words are runs without ASCII white space, A-Z in lower case; a text with fewer words than a shingle has all of them
    as one; without words it has the empty set, links with nothing and is its own component. Two texts are linked if
    100 * intersection >= percent * union of their sets; a component's id is the least id in it, and only that one is
    kept. Rows that repeat an id are one document to the links. Rows without an id link with nothing: their component is
    null and they are kept. Extra columns are not read. An empty table gives no rows. A pair of similarity s is missed by
    all bands with probability (1 - s ** rows) ** bands.
    """
    arrow_rows(docs.sparkSession)
    signed = save(_signed(docs, id_col, text_col, shingle, bands, rows), "signed")
    nodes = signed.where("n_shingles > 0 and id is not null").groupBy("print").agg(F.min(F.struct("id", "bands", "bits")).alias("m")).select("print", F.col("m.id").alias("node"), F.col("m.bands").alias("bands"), F.col("m.bits").alias("bits"))
    nodes = save(nodes, "nodes")
    component = _grouped(docs, id_col, text_col, nodes, shingle, percent)
    named = nodes.select("print", "node").join(component, "node", "left").select(F.col("print").alias("_p"), F.coalesce("component", "node").alias("_c"))
    out = signed.select("id", "n_shingles", "print").join(named, F.col("print") == F.col("_p"), "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("_c", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that are linked with others."""
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").drop("n")
    members = save(banded.join(shared, "key").join(nodes.select("node", "bits", "bands"), "node"), "members")  # node, key, hub, bits, bands

    # first round: each node with the most similar of the least nodes of its buckets
    hubs = members.where("node = hub").select("key", F.col("node").alias("a"), F.col("bits").alias("x"))
    pairs = members.where("node <> hub").select("key", F.col("node").alias("b"), F.col("bits").alias("y")).join(hubs, "key")
    best = _near(pairs, percent).groupBy("b").agg(F.max(F.struct("estimate", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    best = save(best, "best")
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    wanted = members.select("node").distinct()
    texts = save(docs.select(quoted(id_col).alias("node"), text.alias("t")).join(wanted, "node", "left_semi").dropDuplicates(["node", "t"]), "texts")
    links = save(_confirmed(best, texts, shingle, percent), "links")
    component = components(links)
    hub_rows = HUBS
    rest = members.select("key", "node", "bits", "bands")
    while True:
        labelled = rest.join(component, "node", "left").select("key", "node", "bits", "bands", F.coalesce("component", "node").alias("c"))
        open_keys = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        labelled = save(labelled.join(open_keys, "key", "left_semi"), "open")
        free(members)
        if labelled.isEmpty():
            return component
        largest = labelled.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("n"))
        largest = largest.select("key", F.col("m.c").alias("main"), F.expr(f"cast(ceil(n / {PART}) as int)").alias("parts"))
        placed = save(labelled.join(largest, "key"), "placed")
        hubs = placed.where("c <> main").groupBy("key", "parts", F.pmod(F.xxhash64("node"), F.lit(hub_rows)).alias("place")).agg(F.min(F.struct("node", "c", "bits", "bands")).alias("m"))
        hubs = save(hubs.select("key", "parts", F.expr(f"cast(place div {HUBS} as int)").alias("some"), "m.*"), "hubs")
        blocks = hubs.select("key", "some").distinct()
        dealt = placed.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).join(blocks, "key")
        fresh = save(_across(hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), dealt, percent), "near")
        members = save(labelled.select("key", "node", "bits", "bands").join(hubs.select("key", "node"), ["key", "node"], "left_anti"), "members")
        rest = members
        free(labelled, placed, hubs)
        if not fresh.isEmpty():
            more = save(_confirmed(fresh, texts, shingle, percent), "links")
            if not more.isEmpty():
                component = joined_components(component, more)
            free(more)
        free(fresh)
        hub_rows *= 2


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, unchanged, whose id stays: one document of each group, and all rows without an id.

    Of rows that repeat an id one stays, the one with the least text (null counts as empty), of those with the least hash
    of all other columns that can be hashed. Other columns may have any names. An empty table gives no rows.
    """
    kept_col, row_col = unused(docs.columns, "kept", "row")
    found = near_duplicates(docs, id_col, text_col, shingle, percent, bands, rows)
    kept = found.where("kept").select(quoted(id_col).alias(kept_col)).where(F.col(kept_col).isNotNull()).distinct()
    named = docs.where(quoted(id_col).isNotNull()).join(kept, quoted(id_col) == F.col(kept_col), "left_semi")
    others = [quoted(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    least = F.struct(F.coalesce(quoted(text_col).cast("string"), F.lit("")), F.xxhash64(*others))
    one = named.groupBy(quoted(id_col)).agg(F.min_by(F.struct(*map(quoted, docs.columns)), least).alias(row_col))
    one = one.select(*(F.col(row_col).getField(c).alias(c) for c in docs.columns))
    return one.unionByName(docs.where(quoted(id_col).isNull()))
