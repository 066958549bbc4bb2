"""Result tables: upsert, carried timings, aligned unions, duplicates, rankings, spreads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.functions.cleaning import nan_to_null, to_numeric
from tabspark.functions.display import total_time
from tabspark.operators.keys import same_key_join
from tabspark.staging import in_ranges


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str] = spec.RESULT_KEY) -> DataFrame:
    """New rows replace base rows with the same key (missing parts are equal); the rest of the base stays."""
    fresh = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return base.join(fresh, same, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_last(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Last row per key by the order column, as one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")


def carry_over(
    new: DataFrame, old: DataFrame, cols: Sequence[str], keys: Sequence[str] = spec.RESULT_KEY, order: str | None = None
) -> DataFrame:
    """Values of `cols` from the earlier table by key (its last row per key); null for new keys.

    Without an order column the last row is the one that stands last in the table as Spark reads it.
    """
    if order is None:
        old, order = old.withColumn("__order", F.monotonically_increasing_id()), "__order"
    old = keep_last(old.select(*keys, *cols, order), keys, order).drop(order)
    return same_key_join(new.drop(*cols), old.select(*keys, *cols), keys, "left").select(*keys, *[c for c in new.columns if c not in {*keys, *cols}], *cols)


def union_align(frames: Sequence[DataFrame], texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Union of tables with differing columns: absent columns are null, numbers are coerced."""

    def aligned(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        number = {c: (_number(df, c) if c in have else F.lit(None).cast("double")).alias(c) for c in numbers}
        text = {c: (F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in texts}
        return df.select(*text.values(), *number.values())

    if not frames:
        raise ValueError("no result tables")
    return reduce(DataFrame.unionByName, [aligned(df) for df in frames])


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    return to_numeric(F.col(name)) if kind == "string" else nan_to_null(F.col(name).cast("double"))


def run_grid(spark: SparkSession, models: Sequence[str], datasets: Sequence[str], styles: Sequence[str]) -> DataFrame:
    """One row per (model, dataset, serialization); an empty selection gives an empty table."""
    lists = {"model": models, "dataset": datasets, "serialization": styles}
    grid = spark.range(1)
    for name, values in lists.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values]).cast("array<string>")))
    return grid.select("dataset", "model", "serialization")


def average_duplicates(df: DataFrame, by: Sequence[str] = ("dataset", "model_label")) -> DataFrame:
    """Mean of every metric and time per configuration, missing values ignored."""
    values = [c for c in (*spec.QUALITY_METRICS, *spec.TIME_METRICS) if c in df.columns]
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in values])


def dataset_list(df: DataFrame) -> DataFrame:
    """Sorted distinct datasets of a result table."""
    return df.where(F.col("dataset").isNotNull()).select("dataset").distinct().orderBy("dataset")


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """`rank` per dataset: places inside ranges of the order, plus the rows of the lower ranges."""
    ranged = in_ranges(df, "dataset", *order)
    inside = F.row_number().over(Window.partitionBy("dataset", "__r").orderBy(*order))
    upto = Window.partitionBy("dataset").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    lower = ranged.groupBy("dataset", "__r").agg(F.count("*").alias("__n"))
    lower = lower.select(F.col("dataset").alias("__d"), F.col("__r").alias("__q"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__lower"))
    placed = ranged.withColumn("__place", inside).join(
        lower, F.col("dataset").eqNullSafe(F.col("__d")) & (F.col("__r") == F.col("__q"))
    )
    return placed.withColumn("rank", (F.col("__lower") + F.col("__place")).cast("int")).drop("__r", "__d", "__q", "__lower", "__place")


def rank_quality(df: DataFrame) -> DataFrame:
    """`rank` per dataset: macro F1 descending, missing last, ties alphabetical."""
    return _ranked(df, F.desc_nulls_last("test_f1_macro"), F.asc("model_label"))


def rank_runtime(df: DataFrame) -> DataFrame:
    """`rank` per dataset: total runtime ascending, missing last, ties alphabetical."""
    total = total_time(F.col("train_time_seconds"), F.col("prediction_time_seconds"))
    return _ranked(df.withColumn("total_runtime_seconds", total), F.asc_nulls_last("total_runtime_seconds"), F.asc("model_label"))


def time_spread(df: DataFrame, by: Sequence[str], label: str, time: str = "prediction_time_seconds") -> DataFrame:
    """Range of a time per group with the fastest and the slowest run; ties alphabetical."""
    t = F.col(time)
    return (
        df.where(t.isNotNull())
        .groupBy(*by)
        .agg(
            (F.max(t) - F.min(t)).alias("spread"),
            F.min_by(label, F.struct(t, F.col(label))).alias("fastest"),
            F.min_by(label, F.struct(-t, F.col(label))).alias("slowest"),
        )
    )


def time_range(df: DataFrame, by: Sequence[str] = ("dataset",), cols: Sequence[str] = spec.TIME_METRICS) -> DataFrame:
    """Smallest and largest positive time per group, pulled apart by a factor of ten each way when equal."""
    low = F.least(*[F.min(F.when(F.col(c) > 0, F.col(c))) for c in cols])
    high = F.greatest(*[F.max(F.when(F.col(c) > 0, F.col(c))) for c in cols])
    found = df.groupBy(*by).agg(low.alias("__low"), high.alias("__high"))
    same = F.col("__low") == F.col("__high")
    return found.select(
        *by,
        F.when(same, F.col("__low") / 10).otherwise(F.col("__low")).alias("time_min"),
        F.when(same, F.col("__high") * 10).otherwise(F.col("__high")).alias("time_max"),
    )


def best_config(
    scores: DataFrame, config: str, by: Sequence[str] = (), metric: str = "f1_macro", order: str | None = None
) -> DataFrame:
    """Means over the folds of the configuration with the highest mean metric.

    Ties go to the first one in order; a configuration without a mean comes last.
    """
    order = order or config
    metrics = [c for c in ("f1_macro", "accuracy", "precision", "recall", "auc") if c in scores.columns]
    keys = list(dict.fromkeys([*by, config, order]))
    means = scores.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])
    row = F.struct(*list(dict.fromkeys([config, order])), *metrics)
    mean = F.when(~F.isnan(metric), F.col(metric))
    best = means.groupBy(*by).agg(F.min_by(row, F.struct(mean.isNull(), -mean, F.col(order))).alias("__row"))
    return best.select(*by, "__row.*")
