"""One query per operator, over its whole table, and the SQL each must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from saleskiln.llm.byte_bpe import bpe_round_trip
from saleskiln.llm.common import table
from saleskiln.llm.conversations import damaged, repair_pieces, summarise
from saleskiln.llm.decontaminate import find_contamination
from saleskiln.llm.html_extract import extract_main_text, train_extractor
from saleskiln.llm.langid import identify_language, train_languages
from saleskiln.llm.line_quality import clean_lines
from saleskiln.llm.line_spread import drop_spread_lines
from saleskiln.llm.minhash import near_duplicates
from saleskiln.llm.pii import KINDS, pseudonymise
from saleskiln.llm.spelling import TYPO, group_spellings
from saleskiln.llm.substring import drop_repeats
from saleskiln.llm.token_counts import count_tokens
from saleskiln.llm.toxicity import score_toxicity, train_toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


def fold(count: int):
    """Remainder of the checksum of the id, null without an id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(count))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows outside the held-out fold."""
    docs = documents(spark, sf_dir, "lang")
    model = train_languages(docs.where(fold(5) != 0))
    named = identify_language(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    coded = bpe_round_trip(documents(spark, sf_dir))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows inside every document."""
    found = find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.col("items").cast("array<string>"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


@query
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules and verdict of every document."""
    cleaned = clean_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


@query
def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more sites carry."""
    left = drop_spread_lines(documents(spark, sf_dir, "source"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(fold(4) != 2))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms, and how many of each kind."""
    named = pseudonymise(documents(spark, sf_dir))
    count_of = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [count_of(kind) for kind in KINDS]
    return named.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_found"), *counts)


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages, train_extractor(pages)).select("page_id", "url", "text", "n_chars")


@query
def op12_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 35 words that stand anywhere else."""
    left = drop_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, some of which lose a letter first."""
    return group_spellings(documents(spark, sf_dir), typo=TYPO).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged first, with its faults and its cheapest repair."""
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return summarise(repair_pieces(rows, copies="copies"))
