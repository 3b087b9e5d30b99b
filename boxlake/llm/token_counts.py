"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxlake.llm.common import arrow_rows, lean, quoted, text_parts
from boxlake.llm.pieces import KIND, byte_level_spans, pieces, text_sums


def counts_of(column: pa.Array, path: str) -> np.ndarray:
    """Token counts of the texts of an Arrow column (null: 0) for a byte-level BPE file."""
    table, out = pieces(path, False, False), np.zeros(len(column), np.int64)
    for a, z, buf, offsets in text_parts(column):
        starts, ends = byte_level_spans(buf, offsets)
        if len(starts):
            slots = table.find(buf, starts, ends)
            out[a:z] = text_sums(table.lengths[slots], starts, offsets)
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Count the tokens of every whole text: (id, n_bytes long, n_tokens long, over_limit boolean).

    ``path`` names a byte-level BPE file of the tokenizers library, readable by every executor. No begin, end or added
    special token; special strings inside a text are special tokens, as the library has it by default. One row per
    input row: repeated rows, null ids and extra columns are no matter; a null text counts as empty (0 bytes, 0 tokens,
    not over the limit). Nothing is shuffled: memory is one Arrow batch and a bounded table of pieces, whatever a text's
    length.
    """
    arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = counts_of(b.column(1), path)
            size = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).mapInArrow(lean(count, KIND), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
