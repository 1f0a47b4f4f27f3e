"""The corpus pipeline: quality, line dedup, near-duplicate documents, packing.

Each stage takes (spark, docs, sf_dir), ``docs`` being what the stage before kept, and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm import lines, packing, quality, simhash
from tabulens.llm.common import settled
from tabulens.llm.queries import quality_model, tokenizer_path
from tabulens.sources.tables import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from the labels of those given."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_of(model, docs["text"]) >= quality.THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows. Lines are judged by id: rows without id keep theirs."""
    kept = lines.with_kept_text(docs, lines.keep_bitmaps(docs))
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the smallest id, rows without id last."""
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, each placed in a sequence; those of rows without id have a NULL doc_id."""
    return packing.packed(docs, tokenizer_path(), without_id=True)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("simhash", one_of_each),
    ("packing", pack),
]

# A trained model, XXH64 fingerprints and a tokenizer: SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return settled(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
