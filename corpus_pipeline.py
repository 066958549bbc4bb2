"""The corpus pipeline: language ID, line dedup, near dedup, benchmark decontamination, piece counts and round trip.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm import langid, line_dedup, near_dedup, pieces
from tabspark.llm import decontaminate as benchmark_filter
from tabspark.llm.common import Scratch
from tabspark.llm.queries import model_path, table

#: Texts whose best language is less sure than this are rejected, like those without any letter.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows with a language that are not held out; rejects `und` and unsure texts. With nothing to learn from all pass."""
    model = langid.train(docs.where(~langid.held_out()))
    if not model.languages:
        return docs
    judged = langid.identify(docs, model, into="__language")
    return judged.where((F.col("__language.lang_pred") != langid.UNKNOWN) & (F.col("__language.score") >= SURE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; a text of which nothing but white space is left goes."""
    out = line_dedup.dedup_lines(docs, into="__lines")
    kept = F.col("__lines.kept")
    emptied = (F.col("__lines.n_removed") > 0) & (F.trim(F.regexp_replace(kept, line_dedup.SPACE, " ")) == "")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(
        *[
            kept.alias("text") if c == "text" else F.when(F.col("__lines.n_removed") > 0, F.length(kept).cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c)
            for c in docs.columns
        ]
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of texts of similarity 0.8 in five-word shingles."""
    judged = near_dedup.groups(docs, size=5, percent=80).where(~F.col("kept"))
    gone = judged.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"))
    return docs.join(gone, (F.xxhash64(docs["text"]) == F.col("__text")) & docs["doc_id"].eqNullSafe(F.col("__id")), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return benchmark_filter.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids, and digest of the decoded text."""
    return pieces.round_trip(docs.select("doc_id", "text"), model_path()).select("doc_id", "pieces.*")


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("pieces", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
