"""Mixing sources to target weights.

The words of each source lie end to end and are cut into blocks of a fixed length. Output shards have a fixed number of
slots; each shard draws its number of slots of each source from a multinomial conditioned on the sources' totals, so the
mix meets its targets. The j-th slot of a source goes through that source's pseudorandom permutation of its block numbers
(a new one for each pass over the source), and slots join blocks by number. The last slot of a source is cut to what its
target still lacks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_rows, lean, mapped, quoted, running_offsets, save, settle, shuffle_partitions, text_parts, unused, word_spans, words

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: Tables of sources are broadcast up to this number of rows, beyond it they are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Things that are drawn one by one; more are drawn in bulk first.
_FEW = 1 << 16


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; none is above ``most`` times its size, what is over is shared out again."""
    size, weight = np.array(sizes, np.float64), np.array(weights, np.float64)
    left, open_, out = float(sum(sizes)), np.arange(len(size)), np.zeros(len(size))
    while len(open_):
        share = left * weight[open_] / weight[open_].sum()
        full = share > most * size[open_]
        if not full.any():
            out[open_] = share
            break
        out[open_[full]] = most * size[open_[full]]
        left -= float(out[open_[full]].sum())
        open_ = open_[~full]
    return out.tolist()


# ---------------------------------------------------------------- permutations


def _rounds(x: np.ndarray, half: int, keys: Sequence[int], back: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    a, b = x >> np.uint64(half), x & low
    for k in reversed(keys) if back else keys:
        if back:
            a, b = b ^ _mix(a, k, low), a
        else:
            a, b = b, a ^ _mix(b, k, low)
    return a << np.uint64(half) | b


def _mix(x: np.ndarray, key: int, low: np.uint64) -> np.ndarray:
    h = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) & low


def permuted(x: np.ndarray, n: int, seed: Sequence[int], back: bool = False) -> np.ndarray:
    """A bijection of 0..n-1: a Feistel network that is walked until it is within range."""
    keys = [int(k) for k in np.random.Generator(np.random.PCG64(list(seed))).integers(0, 1 << 62, 6)]
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = np.asarray(x, np.uint64)
    out = _rounds(out, half, keys, back)
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = _rounds(out[far], half, keys, back)
    return out.astype(np.int64)


# ---------------------------------------------------------------- plan


@dataclass
class Source:
    name: str | None
    size: int
    target: float
    blocks: int = 0
    want: int = 0
    slots: int = 0
    last: int = 0
    cut: int = 0


def plan_sources(found: Sequence[tuple[str | None, int]], seed: int, block: int = BLOCK_WORDS, weights: Sequence[float] = WEIGHTS) -> list[Source]:
    """Sources by code point, null last, with their targets and slots."""
    found = sorted(found, key=lambda x: (x[0] is None, x[0] or ""))
    aims = targets([n for _, n in found], [weights[i % len(weights)] for i in range(len(found))])
    out = [Source(name, n, t) for (name, n), t in zip(found, aims, strict=True)]
    for i, s in enumerate(out):
        s.want = min(round(s.target), MOST_REPEATS * s.size)
        s.blocks, s.last = -(-s.size // block), (s.size - 1) % block + 1 if s.size else 0
        if s.want:
            passes, rest = divmod(s.want, s.size)
            extra = 0
            if rest:
                at = int(permuted(np.array([s.blocks - 1]), s.blocks, (seed, i, passes), back=True)[0])
                upto = lambda j: j * block - (block - s.last) * (at < j)  # noqa: B023, E731  words of the first j slots of the pass
                extra = max(1, rest // block)
                while upto(extra) < rest:
                    extra += 1
                s.cut = rest - upto(extra - 1)
            s.slots = passes * s.blocks + extra
    return out


def drawn(random: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of each kind are among ``take`` things drawn without replacement, for any numbers.

    Each thing is taken by a coin first (a binomial number of each kind). Given how many these are, they are a random
    subset, and so it stays one when as many as are missing are drawn from the others, or as many as are too many from
    the taken: a far smaller draw of the same sort.
    """
    whole = int(counts.sum())
    if 2 * take > whole:
        return counts - drawn(random, counts, whole - take)
    if take <= _FEW:
        at = np.zeros(0, np.int64)
        while len(at) < take:
            at = np.unique(np.concatenate([at, random.integers(0, whole, take - len(at))]))
        return np.bincount(np.searchsorted(np.cumsum(counts), at, "right"), minlength=len(counts)).astype(np.int64)
    taken = random.binomial(counts, take / whole)
    short = take - int(taken.sum())
    return taken + drawn(random, counts - taken, short) if short >= 0 else taken - drawn(random, taken, -short)


def shard_counts(slots: np.ndarray, shard_slots: int, seed: int, first: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For shards first..end-1: shard, its slots of each source, and the slots of each source before it.

    The slots are split in halves down a tree, each node with a random state of its own, so any task can find the draws
    of its shards without the others. What a half gets is drawn without replacement: the multinomial of its shards,
    conditioned on the sources' totals.
    """
    total = int(slots.sum())
    shards = -(-total // shard_slots)

    def down(lo: int, hi: int, counts: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= end:
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        some = np.flatnonzero(counts)
        left = np.zeros_like(counts)
        left[some] = drawn(np.random.Generator(np.random.PCG64([seed, lo, hi])), counts[some], (mid - lo) * shard_slots)
        yield from down(lo, mid, left, before)
        yield from down(mid, hi, counts - left, before + left)

    if shards:
        yield from down(0, shards, slots, np.zeros_like(slots))


def slots(spark: SparkSession, sources: Sequence[Source], seed: int, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """All output slots: (shard long, slot int, src long, block long, words int, whole boolean: all words of the block)."""
    n = np.array([s.slots for s in sources], np.int64)
    shards = -(-int(n.sum()) // shard_slots)
    plain = [(s.blocks, s.slots, s.last, s.cut) for s in sources]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for shard, counts, before in shard_counts(n, shard_slots, seed, int(ids[0]), int(ids[-1]) + 1) if len(ids) else ():
                src, blocks, size, all_words = [], [], [], []
                for i in np.flatnonzero(counts):
                    of, all_, last, cut = plain[i]
                    j = np.arange(before[i], before[i] + counts[i])
                    number = np.zeros(len(j), np.int64)
                    for p in np.unique(j // of):
                        here = j // of == p
                        number[here] = permuted(j[here] % of, of, (seed, int(i), int(p)))
                    full = np.where(number == of - 1, last, block)
                    taken = np.where(j == all_ - 1, cut, full) if cut else full
                    all_words.append(taken == full)
                    src.append(np.full(len(j), i))
                    blocks.append(number)
                    size.append(taken)
                order = np.random.Generator(np.random.PCG64([seed, shard, 0, 1])).permutation(int(counts.sum()))
                out = [np.concatenate(x)[order].astype(np.int64) for x in (src, blocks, size)]
                k = len(order)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, shard), pa.int64()), pa.array(np.arange(k), pa.int32()), pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int32)), pa.array(np.concatenate(all_words)[order])], names=["shard", "slot", "src", "block", "words", "whole"])

    return spark.range(0, shards, 1, max(1, min(shards, shuffle_partitions(spark)))).mapInArrow(lean(draw), "shard long, slot int, src long, block long, words int, whole boolean")


# ---------------------------------------------------------------- documents


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, key_col: str | None = None) -> DataFrame:
    """(id, source, size long, h long, key long): words of each whole text; h tells rows of one id apart, by their texts
    or, of rows with a key of their own, by all that can be hashed."""
    arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for a, z, buf, offsets in text_parts(b.column(4)):
                starts, _ = word_spans(buf, offsets)
                out[a:z] = np.diff(np.searchsorted(starts, offsets))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out), *b.columns[2:4]], names=["id", "source", "size", "h", "key"])

    text = quoted(text_col).cast("string")
    others = [] if key_col is None else [quoted(c) for c, t in docs.dtypes if c not in (text_col, key_col) and "map<" not in t and "variant" not in t]
    mark = F.xxhash64(F.coalesce(text, F.lit("")), *others)
    key = F.lit(0).cast("long") if key_col is None else quoted(key_col)
    return docs.select(quoted(id_col).alias("id"), quoted(source_col).cast("string").alias("source"), mark.alias("h"), key.alias("key"), text.alias("t")).mapInArrow(lean(count), f"id {kind}, source string, size long, h long, key long")


@dataclass
class Mix:
    """``docs``: (id, source, size, h, key, src, offset); ``segments``: (key, src, offset, size, block, at, skip, n): a document's
    words from word ``at`` on that are words ``skip`` to ``skip + n`` of a block; ``slots``: see slots()."""

    docs: DataFrame
    segments: DataFrame
    slots: DataFrame
    sources: list[Source]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = BLOCK_WORDS, weights: Sequence[float] = WEIGHTS, key_col: str | None = None) -> Mix:
    """Plan the mix. The driver gets one size a source, never rows; every task gets a few numbers for each source."""
    spark = docs.sparkSession
    rows = settle(sized(docs, id_col, text_col, source_col, key_col))
    found = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    sources = plan_sources(found, seed, block, weights)
    schema = "_source string, src long, source_size long, target double"
    named = spark.createDataFrame([(s.name, i, s.size, s.target) for i, s in enumerate(sources)], schema)
    named = F.broadcast(named) if len(sources) <= BROADCAST_SOURCES else named
    numbered = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = running_offsets(numbered, "src", ["id", "h"], "size", "offset")
    first = F.col("offset")
    parts = laid.where("size > 0").select("key", "src", "offset", "size", F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")).alias("block"))
    begin = F.greatest(F.col("block") * block, first)
    segments = parts.select("*", (begin - first).alias("at"), (begin - F.col("block") * block).alias("skip"), (F.least((F.col("block") + 1) * block, first + F.col("size")) - begin).alias("n"))
    return Mix(laid, segments, slots(spark, sources, seed, block), sources)


def takes(m: Mix) -> DataFrame:
    """Segments that the mix takes: columns of ``segments``, ``whole`` (times all of it is taken) and ``part`` (words of one more, cut, take).

    Both sides grow with the corpus: they are merged, never broadcast, however small they look once compressed.
    """
    by_block = m.slots.groupBy("src", "block").agg(F.count_if("whole").alias("whole"), F.max(F.when(~F.col("whole"), F.col("words"))).alias("cut"))
    return m.segments.join(by_block.hint("merge"), ["src", "block"]).withColumn("part", F.least(F.col("n"), F.greatest(F.lit(0), F.coalesce("cut", F.lit(0)) - F.col("skip"))).cast("long")).drop("cut")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """What the mix takes of each document: (id, size long, source_size long, target double, taken long).

    Sources by code point, null last, weigh WEIGHTS in turn and share 100 % of all words; see targets(). A null or empty
    text has size and taken 0. Repeated rows are mixed each for itself; a null id is as good as another. An empty table
    gives no rows; other columns are not read. ``taken`` is at most MOST_REPEATS times ``size``; a source's sum of
    ``taken`` is its target, rounded.
    """
    m = mix(docs, id_col, text_col, source_col, seed)
    got = takes(m).select("src", "offset", (F.col("whole") * F.col("n") + F.col("part")).alias("taken")).groupBy("src", "offset").agg(F.sum("taken").alias("taken"))
    rows = m.docs.withColumn("key", F.when(F.col("size") > 0, F.col("offset")))
    out = rows.join(got.withColumnRenamed("offset", "key").hint("merge"), ["src", "key"], "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The documents as the mix has them: texts hold the taken words, repeated where they are taken again.

    Rows are mixed each for itself, repeated rows and rows without an id too. Documents of which nothing is taken go;
    those without words (null texts among them) stay as they are. Other columns, whatever their names, keep their values;
    ``n_chars`` follows the text. A text that is taken once, whole, is unchanged. An empty table gives no rows. The rows
    are written once with a number each; sizes and places go with the numbers, whole texts are shuffled once.
    """
    names = docs.columns
    number, sized_, spans_, other = unused(names, "number", "sized", "spans", "other")
    schema = docs.schema
    rows = save(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    m = mix(rows, id_col, text_col, source_col, seed, key_col=number)
    spans = takes(m).where("whole > 0 or part > 0").groupBy("key").agg(F.collect_list(F.struct("at", "n", "whole", "part")).alias(spans_))
    kept = m.docs.select("key", F.col("size").alias(sized_)).join(spans, "key", "left").where((F.col(sized_) == 0) | F.col(spans_).isNotNull()).withColumnRenamed("key", other)
    joined = rows.join(kept, F.col(number) == F.col(other))
    at, chars = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], []
            lists, size = b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            for k, t in enumerate(b.column(at).to_pylist()):
                s = sorted((x["at"], x["n"], x["whole"], x["part"]) for x in lists[k] or [])
                if s and not (all(x[2] == 1 and x[3] == 0 for x in s) and sum(x[1] for x in s) == size[k]):
                    t = taken_text(t, s)
                texts.append(t)
                sizes.append(None if t is None else len(t))
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array(sizes, b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[: len(names)])

    return mapped(joined.select(*map(quoted, names), spans_, sized_), build, schema)


def taken_text(text: str, spans: Sequence[tuple[int, int, int, int]]) -> str:
    """The spans' words in order, again for each further take; cut takes come last. It ends with its last word."""
    raw = text.encode()
    _, _, starts, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), want_spans=True)
    edge = [*starts.tolist(), len(raw)]
    parts = [raw[edge[a] : edge[a + n]] for k in range(max(x[2] for x in spans)) for a, n, whole, _ in spans if whole > k]
    parts += [raw[edge[a] : edge[a + p]] for a, _, _, p in spans if p]
    return b"".join(x if x[-1:].isspace() else x + b"\n" for x in parts).rstrip().decode()
