"""Quality classifier: random-indexing word vectors, pooled by document, and a small calibrated network.

Units are words and word forms (a form keeps what kinds of characters a word has, in order: `Aa.`, `a#`, `A!`, `|`, and
whether the word repeats its neighbour). Every word has a fixed sparse ternary index vector; a unit's vector is the sum of
the index vectors of the words around all its occurrences in the whole corpus. A document is the mean of its words' vectors
beside the mean of its forms' vectors, and nothing else. A two-layer network in numpy is fitted on a bounded sample of
labelled rows and its logits are scaled by a temperature. Products are summed in one fixed order, so that a text's score
does not depend on the texts that share its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import FOLDED, PLAIN, SPACE, arrow_rows, lean, mapped, quoted, span_hashes, text_parts, word_spans
from boxlake.llm.toxicity import held_out, labelled_sample

#: Places of the hashed words and forms; dimensions of the vectors; entries of an index vector that are not 0; words on each side.
WORDS, FORMS, DIMENSIONS, ENTRIES, REACH = 1 << 16, 1024, 24, 4, 2
#: Labelled rows that the network is fitted on, about.
SAMPLE = 16_000
UNITS = WORDS + FORMS
#: Rows that the network works on at a time.
HEIGHT = 256
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("9")


def _index_vectors() -> np.ndarray:
    """Sparse ternary vectors: ENTRIES entries of +1 or -1 for each place of a word."""
    random = np.random.Generator(np.random.PCG64(3))
    out = np.zeros((WORDS, DIMENSIONS), np.int8)
    at = np.argsort(random.random((WORDS, DIMENSIONS)), axis=1)[:, :ENTRIES]
    out[np.arange(WORDS)[:, None], at] = random.choice(np.array([-1, 1], np.int8), (WORDS, ENTRIES))
    return out


INDEX = _index_vectors()


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word units, form units (offset by WORDS) and the text of each word."""
    starts, ends = word_spans(buf, offsets)
    h = span_hashes(buf, starts, ends, FOLDED)
    of = np.searchsorted(offsets, starts, "right") - 1
    kinds = _CLASS[buf]
    change = np.ones(len(buf), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[starts] = True
    change |= SPACE[buf]
    at = np.concatenate(([0], np.cumsum(change)))
    form = span_hashes(kinds[change], at[starts], at[ends], PLAIN)
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    f = (form % np.uint64(FORMS - 1)).astype(np.int64)
    f[again] = FORMS - 1
    return (h % np.uint64(WORDS)).astype(np.int64), f + WORDS, of


def neighbour_sums(w: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each word the sum of the index vectors of the words up to REACH places away in its text."""
    own = INDEX[w]
    out = np.zeros(own.shape, np.int16)
    for gap in range(1, min(REACH, len(w) - 1) + 1):
        out[gap:] += own[:-gap]
        out[:-gap] += own[gap:]
        over = np.flatnonzero(of[gap:] != of[:-gap])  # the few that reach over the border of a text
        out[over + gap] -= own[over]
        out[over] -= own[over + gap]
    return out


def add_sums(total: np.ndarray, unit: np.ndarray, sums: np.ndarray) -> None:
    """Add each row of ``sums`` to its unit's row of ``total``."""
    unit = unit.astype(np.uint16 if UNITS <= 1 << 16 else np.uint32)
    order = np.argsort(unit, kind="stable")
    ordered = unit[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    total[ordered[first]] += np.add.reduceat(sums[order], first, axis=0, dtype=np.int32)


def unit_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random-indexing vectors (UNITS, DIMENSIONS) of unit length from all texts; sums of integers, so any order gives the same.

    Each task sends one row a unit that it has met; the sums are UNITS rows, whatever the corpus.
    """
    arrow_rows(docs.sparkSession)
    names = [f"d{i}" for i in range(DIMENSIONS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((UNITS, DIMENSIONS), np.int64)
        for b in batches:
            for _, _, buf, offsets in text_parts(b.column(0)):
                w, f, of = units(buf, offsets) if len(buf) else (np.zeros(0, np.int64),) * 3
                if len(w):
                    sums = neighbour_sums(w, of)
                    add_sums(total, w, sums)
                    add_sums(total, f, sums)
        met = np.flatnonzero(total.any(axis=1))
        for a in range(0, len(met), 1 << 13):
            some = met[a : a + (1 << 13)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(np.ascontiguousarray(total[some, i])) for i in range(DIMENSIONS))], names=["unit", *names])

    rows = docs.select(quoted(text_col).cast("string").alias("t")).mapInArrow(lean(count), "unit long, " + ", ".join(f"{n} long" for n in names))
    got = rows.groupBy("unit").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((UNITS, DIMENSIONS))
    if got.num_rows:
        out[got["unit"].to_numpy()] = np.stack([got[n].to_numpy() for n in names], 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row a text: the means of its word vectors and of its form vectors."""
    out = np.zeros((len(column), 2 * DIMENSIONS), np.float32)
    for a, z, buf, offsets in text_parts(column):
        if not len(buf):
            continue
        w, f, of = units(buf, offsets)
        if not len(w):
            continue
        n = np.bincount(of, minlength=z - a)
        some = np.flatnonzero(n)
        first = np.searchsorted(of, some)
        out[a + some, :DIMENSIONS] = np.add.reduceat(vectors[w], first, 0)
        out[a + some, DIMENSIONS:] = np.add.reduceat(vectors[f], first, 0)
        out[a + some] /= n[some, None]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Sums in one fixed order, in blocks of one height: a row's bits are the same in any batch, unlike with a matrix product."""
        out = np.empty(len(x))
        for a in range(0, len(x), HEIGHT):
            some = x[a : a + HEIGHT]
            block = np.zeros((HEIGHT, x.shape[1]))
            block[: len(some)] = (some - self.mean) / self.scale
            hidden = np.tile(self.b1, (HEIGHT, 1))
            for j in range(x.shape[1]):
                hidden += block[:, j, None] * self.w1[j]
            hidden = np.tanh(hidden)
            total = np.full(HEIGHT, self.b2)
            for j in range(hidden.shape[1]):
                total += hidden[:, j] * self.w2[j]
            out[a : a + HEIGHT] = total[: len(some)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities that the label is 1; a row at a time is as good as all."""
        out = np.empty(len(x))
        logits = self.logits(x.astype(np.float64)) / self.temperature
        for a in range(0, len(x), HEIGHT):
            some = logits[a : a + HEIGHT]
            out[a : a + HEIGHT] = (1 / (1 + np.exp(-np.clip(np.r_[some, np.zeros(HEIGHT - len(some))], -35, 35))))[: len(some)]
        return out


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature is the best one for the other fifth."""
    random = np.random.Generator(np.random.PCG64(seed))
    x = x.astype(np.float64)
    net = Network(x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 1e-3 if len(x) else np.ones(x.shape[1]), random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), 0.0)
    if not len(x):
        net.w2[:] = 0
        return net
    order = random.permutation(len(x))
    own, other = (order[len(x) // 5 :], order[: len(x) // 5]) if len(x) >= 50 else (order, order)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    scaled = (x - net.mean) / net.scale
    for epoch in range(epochs):
        lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
        for part in np.array_split(random.permutation(own), max(1, len(own) // 256)):
            a = np.tanh(scaled[part] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -35, 35))) - y[part]) / len(part)
            back = np.outer(d, params[2]) * (1 - a * a)
            step += 1
            for p, g, m, v in zip(params, (scaled[part].T @ back, back.sum(0), a.T @ d, d.sum(keepdims=True)), first, second, strict=True):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    raw = net.logits(x[other])

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, np.where(y[other] > 0, -raw, raw) / t)))

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Unit vectors from all texts; the network from about ``sample`` labelled rows that are not held out."""
    vectors = unit_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "y", "x"])

    rows = labelled_sample(docs, labels, label_col, id_col, text_col, sample)
    kind = rows.schema["_id"].dataType.simpleString()
    got = rows.mapInArrow(lean(pool), f"_id {kind}, y int, x binary").toArrow().sort_by([("_id", "ascending")])
    x = np.array([np.frombuffer(v.as_py(), np.float32) for v in got["x"]], np.float32).reshape(-1, 2 * DIMENSIONS)
    return vectors, fit(x, got["y"].to_numpy().astype(float))


def scored(docs: DataFrame, vectors: np.ndarray, net: Network, id_col: str, text_col: str, threshold: float, keep_rows: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    names = docs.columns
    arrow_rows(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value[1].score(pooled(b.column(2), shared.value[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            column = b.column(at)
            yield b.filter(pa.array(shared.value[1].score(pooled(column.cast(pa.string()), shared.value[0])) >= threshold))

    if keep_rows:
        return mapped(docs, keep, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(quoted(id_col).alias("id"), held_out(quoted(id_col)).alias("held_out"), quoted(text_col).cast("string").alias("t"))
    return out.mapInArrow(lean(score), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Score every whole text: (id, held_out boolean, score double, predicted int).

    One row per input row, whatever its other columns. A null text counts as empty; both get the score of a document
    without words. A null id is not held out; null labels are not learned from. Without labels all scores are 0.5.
    """
    return scored(docs, *train(docs, labels, id_col, text_col, label_col, sample), id_col, text_col, threshold, False)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, unchanged, whose texts score ``threshold`` or more.

    All columns stay, whatever their names. Null and empty texts have the score of a document without words; repeated
    rows stay or go together; an empty table gives no rows. Without labels all scores are 0.5, so all rows stay.
    """
    return scored(docs, *train(docs, labels, id_col, text_col, label_col, sample), id_col, text_col, threshold, True)
