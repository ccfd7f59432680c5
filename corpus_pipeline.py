"""The corpus pipeline: stages of documents, each written as Parquet and read again as the next one's input.

Every stage works on all that its predecessor kept and carries documents with
null ids on, empty tables as empty tables, and texts of any length whole. The
last stage returns the tokens' digests in place of texts. Columns other than
those of documents are not read. Rows that repeat a doc_id with another text are
documents of their own in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlake.llm import bpe_sentencepiece, bwt_dedup, decontaminate, ngram_join, quality_rules
from courierlake.llm.shared import cut, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = docs.select(F.struct(*COLUMNS).alias("row"), "doc_id", "text")
    return quality_rules.quality_rules(judged, carry="row").where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that n-gram similarity links: that with the smallest id, and once if its row repeats."""
    classes = ngram_join.jaccard_classes(docs)
    told = cut(classes.where("not first or rows > 1").select("doc_id", "m", "first").distinct())
    key = ["doc_id", "m"]
    left = docs.select(*COLUMNS, F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("m"))
    # merged at every size: texts are shuffled once, whether or not the keys would fit a broadcast
    left = left.join(told.where("not first").select(*key).hint("merge"), key, "left_anti")
    again = cut(told.where("first").select(*key))
    if again.isEmpty():
        return left.select(*COLUMNS)
    # only documents whose row repeats are shuffled to be kept once
    once = left.join(again, key, "left_anti").select(*COLUMNS)
    return once.unionByName(left.join(again, key, "left_semi").dropDuplicates(key).select(*COLUMNS))


def common_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has too; a character that loses a byte goes with them."""
    rows = docs.select("doc_id", "text", F.struct("text", "lang", "source", "n_chars").alias("row"))
    done = bwt_dedup.remove_common(rows, carry="row", characters=True)
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept").cast("string"))
    out = done.select("doc_id", text.alias("text"), "row.lang", "row.source", F.col("row.n_chars").alias("n_chars"), "n_removed")
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.select("doc_id", "text", "lang", "source", size.alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no question of the benchmark; a null doc_id stays."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_row=True)
    gone = cut(found.select("doc_id", "doc_row").distinct())
    own = docs.select(*COLUMNS, decontaminate.row_of(F.col("text")).alias("doc_row"))
    return own.join(gone, ["doc_id", "doc_row"], "left_anti").select(*COLUMNS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and what they decode to, as digests."""
    return bpe_sentencepiece.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", common_strings),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table goes when the next one's is there."""

    def to(last: int) -> DataFrame:
        docs = settled(spark, lambda: to(last - 1)) if last else spark.read.parquet(f"{sf_dir}/documents.parquet")
        return STAGES[last][1](spark, docs, sf_dir)

    return to(len(STAGES) - 1)


#: Stages 2, 3 and 5 have no SQL; tests hold them against brute force.
ORACLE_SQL = None
