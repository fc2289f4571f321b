"""The corpus pipeline: quality rules, near-deduplication, repeated passages, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored as Parquet and read again as the next one's
docs. All but the last return the columns of documents; each works on all that its predecessor kept. Null ids, empty
texts, repeated rows and empty tables follow the rules in each operator's own docstring; no stage fails on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldhouse.llm import decontaminate, near_dup, piece_codec, quality, substring_dedup
from fieldhouse.llm.queries import model_file
from fieldhouse.llm.util import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the smallest id stays."""
    return near_dup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier are cut out of the texts; documents stay."""
    return substring_dedup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and decoded text of what is left, as digests."""
    return piece_codec.contract(docs, model_file())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: SQL can express neither the outlier test nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
