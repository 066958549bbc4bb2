"""Statistics over evaluated answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark import spec


# Slices of a run that are ranked apart before the run as a whole.
SLICES = 256


def percent(n: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.try_divide(100.0 * n, total))


def invalid_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share and kinds of answers without a usable label, over all answers."""
    status = F.col("parse_status")
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_examples"),
        F.count_if(status == "non_relevant").alias("non_relevant_responses"),
        F.count_if(status == "ambiguous").alias("ambiguous_responses"),
    )
    bad = F.col("non_relevant_responses") + F.col("ambiguous_responses")
    return out.withColumn("invalid_response_pct", percent(bad, F.col("n_examples")))


def answer_distribution(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positive, negative and invalid answers per run, as counts and as percent of all answers."""
    label = F.col("parsed_prediction")
    names = {"positive": spec.ANSWER_LABELS[1], "negative": spec.ANSWER_LABELS[0], "invalid": spec.INVALID_LABEL}
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(label == F.lit(v)).alias(k) for k, v in names.items()]
    )
    return out.withColumns({f"{k}_pct": percent(F.col(k), F.col("n")) for k in names})


def answer_patterns(df: DataFrame, by: Sequence[str], k: int, col: str = "output") -> DataFrame:
    """The k most frequent distinct answers per run; ties in text order.

    Answers are counted first, then ranked inside slices of each run, and the best k of every slice in the run.
    """
    counted = df.groupBy(*by, col).agg(F.count("*").alias("n"))
    best_first = [F.desc("n"), F.asc_nulls_first(col)]
    sliced = Window.partitionBy(*by, F.pmod(F.xxhash64(col), F.lit(SLICES))).orderBy(*best_first)
    counted = counted.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= k).drop("rank")
    order = Window.partitionBy(*by).orderBy(*best_first)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
