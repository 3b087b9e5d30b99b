"""The corpus pipeline: quality, near-duplicates, secrets, mix, packing.

Each stage works on all rows that the stage before it kept, written as Parquet and read again. All but the last return
the columns of ``documents``; the last returns the pieces of the packed documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxlake.llm.common import save
from boxlake.llm.entry import tokenizer
from boxlake.llm.mixing import mixed_documents
from boxlake.llm.neardup import first_of_each
from boxlake.llm.packing import pack_documents
from boxlake.llm.quality import keep_good
from boxlake.llm.secrets import redact

#: The near-duplicates stage links documents of this similarity. A pair at exactly 0.8 is missed by all bands with probability 3e-6.
PERCENT, BANDS, ROWS = 80, 54, 7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; see keep_good() for nulls, repeated rows, empty tables, other columns."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, and all rows without an id; see first_of_each()."""
    return first_of_each(docs, percent=PERCENT, bands=BANDS, rows=ROWS)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no row goes. See redact()."""
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts hold the words that the mix takes of them; documents without words stay. See mixed_documents()."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the permitted sequence lengths; documents without tokens have one row and no bin. See pack()."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", good_documents), ("near-duplicates", distinct_documents), ("secrets", clean_documents), ("mix", mixed), ("packing", packed)]

#: SQL can express neither the classifier nor the draws and the packing; tests/llm holds what the stages call against brute
#: force: kept ids, one row of each group, redacted spans, words of the mix, tokens of the bins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
