"""The registered queries of this subpackage, their SQL where SQL can express them, and production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldhouse.llm import chat, decontaminate, divergence, language_id, main_text, near_dup, piece_codec, quality, sharding, substring_dedup, turn_repair, url_filter, warc
from fieldhouse.llm.util import table


def model_file() -> str:
    """The public piece model; a parameter of the operator."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.contract(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.contract(table(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.contract(table(spark, sf_dir, "pages"))


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract(table(spark, sf_dir, "documents"))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.contract(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.contract(table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.contract(table(spark, sf_dir, "documents"), model_file())


def op8_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.contract(table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.contract(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.contract(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.contract(table(spark, sf_dir, "documents"))


def op13_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.contract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_trees, op2_virtual_slots, op3_warc_archive, op4_quality_outliers, op5_chosen_path, op6_suffix_dedup, op7_piece_codec, op8_chat_round_trip, op9_language_id, op10_decontaminate,
        op11_turn_repair, op12_source_divergence, op13_line_blocks,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_archive": warc.ORACLE_SQL,
    "op5_chosen_path": near_dup.ORACLE_SQL,
    "op6_suffix_dedup": substring_dedup.ORACLE_SQL,
    "op8_chat_round_trip": chat.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
    "op11_turn_repair": turn_repair.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op13_line_blocks": main_text.ORACLE_SQL,
}
