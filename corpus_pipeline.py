"""From raw documents to token ids: STAGES in order, each on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. Stages after
the first read what was written for them, so a lost executor costs a stage's own work at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from saleskiln.llm.byte_bpe import bpe_round_trip
from saleskiln.llm.common import Scratch, table
from saleskiln.llm.decontaminate import find_contamination
from saleskiln.llm.langid import identify_language, train_languages
from saleskiln.llm.line_spread import drop_spread_lines
from saleskiln.llm.minhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose sets of five-word shingles share this percentage of their union are near copies here.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter and uncertain ones go. Learns from four of five
    labelled rows, as the query does; the label is no input of a decision."""
    model = train_languages(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    return identify_language(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those that consisted of nothing else go. n_chars follows."""
    left = drop_spread_lines(docs.select(*COLUMNS))
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return near_duplicates(docs.select(*COLUMNS), percent=NEAR_PERCENT).where("kept").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text again."""
    coded = bpe_round_trip(docs.select(*COLUMNS))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: A trained language model is no SQL. tests/llm/test_pipeline.py holds all rows of a whole run to a plain version that
#: works in memory, with the same model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one stays lazy."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
