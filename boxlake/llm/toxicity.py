"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on a bounded sample of labelled rows (``sample``, documented in train()); its L1 term leaves few
weights, so they are broadcast as they are. Every whole text is scored on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import FOLDED, arrow_rows, free, lean, mixed, quoted, save, settle, span_hashes, text_parts, word_spans

BITS = 22
#: Labelled rows that the model is fitted on, about; a feature counts when so many of them have it.
SAMPLE, LEAST_TEXTS = 16_000, 5
_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KEPT = _WORD.copy()
_KEPT[[0x20, *range(0x09, 0x0E)]] = True


def grams(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features and their text: letters-only words, pairs of neighbours, and pairs with one word between."""
    keep = np.concatenate(([0], np.cumsum(_KEPT[buf])))
    letters, borders = buf[_KEPT[buf]], keep[offsets]  # marks and digits within a word don't hide it
    starts, ends = word_spans(letters, borders)
    h = span_hashes(letters, starts, ends, FOLDED)
    of = np.searchsorted(borders, starts, "right") - 1
    down = np.uint64(64 - bits)
    yield (h >> down).astype(np.int64), of
    for gap, salt in ((1, 0x51), (2, 0x77)):
        if len(h) > gap:
            same = of[gap:] == of[:-gap]
            yield (mixed(h[:-gap] * np.uint64(3) + h[gap:] * np.uint64(5) + np.uint64(salt)) >> down).astype(np.int64)[same], of[gap:][same]


def once(slots: list[np.ndarray], texts: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once a text."""
    both = np.unique(np.concatenate(texts) << bits | np.concatenate(slots))
    return both & ((1 << bits) - 1), both >> bits


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    return once(*zip(*grams(buf, offsets, bits), strict=True), bits)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.slots] = self.weights
        return out

    def score(self, column: pa.Array, dense: np.ndarray | None = None) -> np.ndarray:
        """Probabilities that the label is 1; ``dense`` is dense(), held for a task's batches."""
        dense = self.dense() if dense is None else dense
        out = np.zeros(len(column))
        for a, z, buf, offsets in text_parts(column):
            if len(buf):
                found = [(s[w], of[w]) for s, of in grams(buf, offsets, self.bits) if len(w := np.flatnonzero(dense[s]))]
                if found:
                    slot, of = once(*zip(*found, strict=True), self.bits)
                    out[a:z] = np.bincount(of, dense[slot], z - a)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -35, 35)))


def fit(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 3.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5, passes: int = 6, least: int = LEAST_TEXTS, seed: int = 5) -> Model:
    """FTRL-proximal: a learning rate for each coordinate, weights from the accumulated gradients, zero within L1.

    A feature comes in when it has been met in ``least`` examples (features of a few texts only learn those by heart).
    """
    met = np.zeros(1 << bits, np.int32)
    for at in examples:
        met[at] += 1
    examples = [at[met[at] >= least] for at in examples]
    z, n = np.zeros(1 << bits, np.float64), np.zeros(1 << bits, np.float64)
    zb = nb = bias = 0.0
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        for k in random.permutation(len(examples)):
            at = examples[k]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            bias = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            grown = np.sqrt(ni + g * g)
            z[at] = zi + g - (grown - root) / alpha * w
            n[at] = ni + g * g
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias, nb + g * g
    slots = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[slots]) * l1 - z[slots]) / ((beta + np.sqrt(n[slots])) / alpha + l2)
    return Model(slots.astype(np.int64), w.astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha)), bits)


def held_out(id_: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(id, y, text) of about ``sample`` labelled rows (all, if there are fewer), chosen by a hash of the id.

    Of contradicting labels of one id, the larger holds; of repeated rows of one id, the greatest text, so the sample is
    bounded however often an id is repeated. The chosen ids are at most about ``sample``, so they may be broadcast: no
    other texts are shuffled.
    """
    known = labels.where(quoted(label_col).isNotNull() & quoted(id_col).isNotNull() & ~held_out(quoted(id_col))).groupBy(quoted(id_col).alias("_id")).agg(F.max(quoted(label_col)).cast("int").alias("y"))
    known = settle(known)
    total = known.count()
    share = min(1.0, sample / max(1, total))
    chosen = known.where(F.xxhash64(F.col("_id")).bitwiseAND((1 << 40) - 1) < round(share * (1 << 40)))
    return docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("y").alias("y"), F.max("t").alias("t"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on about ``sample`` (the bound of what reaches the driver) labelled rows that are not held out; whole texts.

    Features are counted on the executors first: what fewer than LEAST_TEXTS texts have goes nowhere.
    """
    spark = docs.sparkSession
    arrow_rows(spark)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: list[bytes] = []
            for a, z, buf, offsets in text_parts(b.column(2)):
                slot, of = features(buf, offsets, bits) if len(buf) else (np.zeros(0, np.int64),) * 2
                cuts = np.searchsorted(of, np.arange(z - a + 1))
                lists += [slot[p:q].astype(np.int32).tobytes() for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.binary())], names=["_id", "y", "f"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(1 << bits, np.int32)
        for b in batches:
            for x in b.column(0).to_pylist():
                met[np.frombuffer(x, np.int32)] += 1
        slots = np.flatnonzero(met)
        for a in range(0, len(slots), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(slots[a : a + (1 << 16)].astype(np.int32)), pa.array(met[slots[a : a + (1 << 16)]])], names=["slot", "n"])

    rows = labelled_sample(docs, labels, label_col, id_col, text_col, sample)
    kind = rows.schema["_id"].dataType.simpleString()
    found = save(rows.mapInArrow(lean(hashed), f"_id {kind}, y int, f binary"), "features")
    often = found.select("f").mapInArrow(lean(counted), "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    kept = np.zeros(1 << bits, bool)
    kept[often.select("slot").toArrow()["slot"].to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(kept))

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            lists = [np.frombuffer(x, np.int32) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([x[keep[x]].tobytes() for x in lists], pa.binary())], names=["_id", "y", "f"])

    got = found.mapInArrow(lean(pruned), f"_id {kind}, y int, f binary").toArrow().sort_by([("_id", "ascending")])
    free(found)
    return fit([np.frombuffer(x.as_py(), np.int32) for x in got["f"]], got["y"].to_numpy().astype(float), bits)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """Score every whole text: (id, held_out boolean, score double, predicted int).

    One row per input row, whatever its columns; a null text counts as empty and, like an empty one, gets the score of
    the bias alone; a null id is not held out. Without labels the bias is 0 and all scores are 0.5. Repeated rows get
    equal scores.
    """
    arrow_rows(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, label_col, sample)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = shared.value.dense()
        for b in batches:
            s = shared.value.score(b.column(2), dense)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    out = docs.select(quoted(id_col).alias("id"), held_out(quoted(id_col)).alias("held_out"), quoted(text_col).cast("string").alias("t"))
    return out.mapInArrow(lean(score), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
