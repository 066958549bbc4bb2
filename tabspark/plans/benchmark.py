"""Fit, score and measure models on prepared tables; merge and rank what came out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.functions.cleaning import threshold
from tabspark.functions.display import model_label
from tabspark.operators import results
from tabspark.operators.learn import TunedTrees
from tabspark.operators.metrics import binary_metrics
from tabspark.staging import staged


@dataclass(frozen=True)
class Scored:
    """Scored test rows (target, prob, pred) of one fitted model, with the seconds both steps took."""

    rows: DataFrame
    train_seconds: float
    predict_seconds: float


def fit_and_score(table: DataFrame, model, target: str = "target") -> Scored:
    """Fit on the training rows, score the test rows once.

    `model` has fit(train) -> model and score(test) -> test rows with a column `prob`. Training time covers fit;
    prediction time covers writing the scored test rows, which every metric then reads.
    """
    started = perf_counter()
    fitted = model.fit(table.where(F.col("split") == "train").drop("split"))
    fitted_at = perf_counter()
    scored = staged(fitted.score(table.where(F.col("split") == "test").drop("split")).select(target, "prob"))
    done = perf_counter()
    return Scored(scored.withColumn("pred", threshold(F.col("prob"))), fitted_at - started, done - fitted_at)


def measure(scored: Scored, target: str = "target") -> DataFrame:
    """One row: metrics and times."""
    measured = binary_metrics(scored.rows, target, "pred", "prob")
    times = {"train_time_seconds": scored.train_seconds, "prediction_time_seconds": scored.predict_seconds}
    return measured.withColumns({k: F.lit(v) for k, v in times.items()})


def evaluate(table: DataFrame, model, target: str = "target") -> DataFrame:
    return measure(fit_and_score(table, model, target), target)


def tuned_result(row: DataFrame, model) -> DataFrame:
    """Add the chosen parameters and the validation means (named train_*, as in the published tables)."""
    if not isinstance(model, TunedTrees):
        return row
    extra = {"best_parameters": F.lit(str(model.best_parameters))}
    extra |= {f"train_{k}": F.lit(v) for k, v in model.cross_validation_metrics().items()}
    return row.withColumns(extra)


def run_benchmark(tables: Mapping[str, DataFrame], families: Mapping[str, Callable[[DataFrame], object]]) -> DataFrame:
    """Every model family on every prepared table: one result row each. A family makes a fresh model for a table."""
    rows = []
    for source, make in families.items():
        for dataset, table in tables.items():
            model = make(table)
            row = tuned_result(evaluate(table, model), model)
            rows.append(row.withColumns({"dataset": F.lit(dataset), "source": F.lit(source)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def feature_columns(table: DataFrame, besides: Sequence[str] = ()) -> list[str]:
    return [c for c in table.columns if c not in {"target", "split", "fold", *besides}]


def label_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Result tables with a `source` column -> one aligned table with readable labels."""
    texts = ["dataset", "source", "model", "serialization", "approach"]
    merged = results.union_align(frames, texts, [*spec.QUALITY_METRICS, *spec.TIME_METRICS])
    label = model_label(F.col("source"), F.col("model"), F.col("serialization"), F.col("approach"))
    return merged.select("dataset", label.alias("model_label"), *spec.QUALITY_METRICS, *spec.TIME_METRICS)


def compare_results(labelled: DataFrame) -> DataFrame:
    """Averaged configurations with their quality and runtime rank per dataset."""
    averaged = results.average_duplicates(labelled)
    quality = results.rank_quality(averaged).withColumnRenamed("rank", "quality_rank")
    return results.rank_runtime(quality).withColumnRenamed("rank", "runtime_rank")
