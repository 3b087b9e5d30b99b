"""Token-id files: ids in document order, compressed shard by shard with a Re-Pair grammar.

A shard's image is little-endian: magic, counts, then document ids (with null marks), the end of each document in
symbols, the rules (left and right symbol), the expansion length of each rule, and the symbols. Frequent neighbouring
pairs are replaced by nonterminals, a batch of the most frequent pairs a round, until none is frequent; pairs never reach over the end
of a document, so any document is decoded alone from its own symbols. Images are rows of a Parquet table in the shared
folder: Spark's commit protocol makes a lost executor's shard whole again, on any file system that Spark knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_rows, fresh_path, lean, quoted, shuffle_partitions, text_parts
from boxlake.llm.pieces import KIND, pieces, text_sums, word_level_spans

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIIQQB")
#: Ids of one shard, about.
SHARD_IDS = 1 << 20
ROUND_PAIRS, LEAST_COUNT = 4000, 12
_BITS = 20


# ---------------------------------------------------------------- grammar


def compress(ids: np.ndarray, ends: np.ndarray, base: int, batch: int = ROUND_PAIRS, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: symbols, the end of each document in symbols, and the rules as an (n, 2) array.

    Symbols below ``base`` are ids, ``base + i`` is rule i. Each round counts all neighbouring pairs exactly and gives
    the (at most ``batch``) most frequent, met ``least`` times or more, a rule; overlapping occurrences are taken from
    the left, and of pairs that meet in a hash place the last has its turn, the others have theirs in later rounds. It
    stops when no pair is that frequent, whatever the depth of the rules. Symbols are widened when 16 bits don't hold them.

    A replacement makes no new pair of old symbols, so from the second round on only pairs with a symbol of the last round
    and those that waited for their turn are counted: the counts are still exact.
    """
    s, ends, rules, made = ids.astype(np.uint32), ends.astype(np.int64), [], 0
    fresh, waiting = 0, np.zeros((0, 2), np.uint32)
    while True:
        narrow = base + made + batch < 1 << 16
        kind, shift = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
        spread = kind(0x9E3779B1) if narrow else kind(0x9E3779B97F4A7C15)
        down = kind((32 if narrow else 64) - _BITS)
        s = s.astype(np.uint16 if narrow else np.uint32, copy=False)
        if len(s) < 2:
            break
        keys = (s[:-1].astype(kind) << shift) | s[1:]
        none = np.iinfo(kind).max  # of two symbols that don't exist
        keys[ends[(ends > 0) & (ends < len(s))] - 1] = none
        at = None  # all
        if made:
            wait = np.zeros(1 << _BITS, bool)
            wait[(((waiting[:, 0].astype(kind) << shift) | waiting[:, 1]) * spread) >> down] = True
            young = s >= base + fresh
            at = np.flatnonzero(young[:-1] | young[1:] | wait[(keys * spread) >> down])
            keys = keys[at]
            if not len(keys):
                break
        ordered = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(first, append=len(ordered))
        counts[-1] = 0 if ordered[-1] == none else counts[-1]
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = ordered[first[often[np.lexsort((ordered[first[often]], -counts[often]))]]]
        chosen = often[:batch]
        number = np.full(1 << _BITS, -1, np.int16)
        number[(chosen * spread) >> down] = np.arange(len(chosen))  # of pairs that meet in a place, the last has it
        waiting = np.concatenate((chosen[number[(chosen * spread) >> down] != np.arange(len(chosen))], often[batch:]))
        waiting = np.stack([waiting >> shift, waiting & kind((1 << int(shift)) - 1)], 1).astype(np.uint32)
        place = number[(keys * spread) >> down]
        met = np.flatnonzero(chosen[place] == keys)
        place, hit = place[met], met if at is None else at[met]
        alone = np.ones(len(hit), bool)
        alone[1:] = hit[1:] != hit[:-1] + 1
        begin = np.flatnonzero(alone)
        odd = (hit - np.repeat(hit[begin], np.diff(begin, append=len(hit)))) & 1
        hit, place = hit[odd == 0], place[odd == 0]
        used = np.zeros(len(chosen), bool)
        used[place] = True
        new = (base + made + np.cumsum(used) - 1)[place]
        fresh = made
        made += int(used.sum())
        used = chosen[used]
        rules.append(np.stack([(used >> shift).astype(np.uint32), (used & kind((1 << int(shift)) - 1)).astype(np.uint32)], 1))
        s[hit] = new
        keep = np.ones(len(s), bool)
        keep[hit + 1] = False
        ends = np.concatenate(([0], np.cumsum(keep, dtype=np.int32)))[ends]
        s = s[keep]
    return s.astype(np.uint16 if base + made <= 1 << 16 else np.uint32), ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _gather(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.cumsum(n, dtype=np.int64)
    return np.repeat(first - (total - n), n) + np.arange(total[-1] if len(total) else 0)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that each rule stands for, one after another, and their numbers."""
    symbols, of = np.arange(base, base + len(rules), dtype=np.int64), np.arange(len(rules))
    while len(high := np.flatnonzero(symbols >= base)):
        n = np.ones(len(symbols), np.int64)
        n[high] = 2
        right = np.cumsum(n) - 1
        pair = rules[symbols[high] - base]
        symbols, of = np.repeat(symbols, n), np.repeat(of, n)
        symbols[right[high] - 1], symbols[right[high]] = pair[:, 0], pair[:, 1]
    return symbols.astype(np.uint32), np.bincount(of, minlength=len(rules)).astype(np.int64)


def image(doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    s, symbol_ends, rules = compress(ids, ends, base)
    lengths = expansions(rules, base)[1]
    head = HEAD.pack(MAGIC, base, len(doc_ids), len(rules), len(s), len(ids), s.dtype.itemsize)
    return b"".join((head, doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), symbol_ends.astype("<u8").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), s.astype(f"<u{s.dtype.itemsize}").tobytes()))


class Shard:
    """An image, opened for decoding of all or of single documents."""

    def __init__(self, data: bytes):
        magic, self.base, n, r, m, self.n_ids, width = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls, self.symbol_ends = take("<i8", n), take("u1", n).astype(bool), take("<u8", n).astype(np.int64)
        self.rules, self.lengths = take("<u4", 2 * r).reshape(-1, 2), take("<u4", r)
        self.symbols = take(f"<u{width}", m)
        ids, lengths = expansions(self.rules, self.base)
        if not np.array_equal(lengths, self.lengths):
            raise ValueError("expansion lengths don't fit the rules")
        self.flat = np.r_[np.arange(self.base, dtype=np.uint32), ids]
        self.size = np.r_[np.ones(self.base, np.int64), lengths]
        self.first = np.r_[np.arange(self.base), self.base + np.cumsum(lengths) - lengths]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[_gather(self.first[symbols], self.size[symbols])]

    def ends(self) -> np.ndarray:
        """The end of each document in ids, from the expansion lengths alone."""
        return np.r_[0, np.cumsum(self.size[self.symbols], dtype=np.int64)][self.symbol_ends]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_ends[k - 1] if k else 0 : self.symbol_ends[k]])


# ---------------------------------------------------------------- Spark


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Write the token ids of all texts, each followed by ``end_id``, in ascending id order to shards below ``path``.

    Rows: part (range partition), shard (number in it), first (ids of the part before the shard), n_ids, n_docs, image.
    ``id_col`` must be integral; null ids come first; rows of one id are ordered by text, and dealt over tasks by its
    beginning. A null text counts as empty and has just the end id. Extra columns are not read. An empty table gives no shard. A task holds one shard at a time,
    or one text, if that is longer.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = pieces(tokenizer_path, True, True), TaskContext.get().partitionId()
        base = max(table.tokenizer.get_vocab_size(), end_id + 1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = shard = first = 0

        def flush() -> pa.RecordBatch:
            nonlocal count, shard, first, held
            lengths = np.concatenate([x[3] for x in held])
            data = image(*(np.concatenate([x[k] for x in held]) for k in range(3)), np.cumsum(lengths), base)
            out = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "first": first, "n_ids": count, "n_docs": len(lengths), "image": data}], SHARD_SCHEMA)
            shard, first, count, held = shard + 1, first + count, 0, []
            return out

        for b in batches:
            names, missing = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, z, buf, offsets in text_parts(b.column(1)):
                starts, ends = word_level_spans(buf, offsets)
                slots = table.find(buf, starts, ends)
                n = text_sums(table.lengths[slots], starts, offsets)
                ids = np.insert(table.expand(slots).astype(np.uint32), np.cumsum(n), end_id)
                held.append((names[a:z], missing[a:z], ids, n + 1))
                count += len(ids)
                if count >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    rows.mapInArrow(lean(write, KIND), "part int, shard int, first long, n_ids long, n_docs int, image binary").write.option("compression", "zstd").parquet(path)


SHARD_SCHEMA = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("image", pa.binary())])


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Decode the shards below ``path``: (id, start long, n_tokens long, ids_crc32 long[, ids array<long>]) by document.

    Only one total a part (range partition) reaches the driver, never one a document or shard. A task has the images of
    one split of the table in memory and decodes them one at a time.
    """
    shards = spark.read.schema("part int, shard int, first long, n_ids long, n_docs int, image binary").parquet(path)
    base, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        base[r["part"]], total = total, total + r["n"]
    names = ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = Shard(data.as_py())
                ids, ends = x.expand(x.symbols).astype("<u4"), x.ends()
                starts = np.r_[0, ends[:-1]].astype(np.int64)
                crc = np.array([zlib.crc32(ids[p:q]) for p, q in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
                out = [pa.array(x.doc_ids, pa.int64(), mask=x.nulls), pa.array(starts + base[part] + first), pa.array(ends - starts), pa.array(crc)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[starts, ends[-1:]].astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    out = shards.select("part", "first", "image").mapInArrow(lean(read), "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files to the shared folder and read them back; see write_token_files and read_token_files."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, end_id, path, id_col, text_col)
    return read_token_files(docs.sparkSession, path, id_col)
