"""Prompts -> answers -> evaluated answers -> run results, for all runs in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.functions.answers import parse_answer
from tabspark.functions.cleaning import expected_answer, is_correct
from tabspark.operators.keys import same_key_join
from tabspark.operators import metrics, responses, results
from tabspark.operators.clean import SHOWN_VALUES
from tabspark.operators.learn import batch_score
from tabspark.plans.serialize import with_prompt
from tabspark.sources.readers import load_serialized
from tabspark.sources.writers import append_run_log, read_run_log, write_responses
from tabspark.staging import path_exists

BY = list(spec.RESULT_KEY)


def answer_job(
    df: DataFrame,
    dataset: spec.DatasetSpec,
    style: str,
    model: str,
    scorer_factory: Callable[[], Callable],
    key: str,
    max_examples: int | None = None,
    batch_size: int = 1,
    inputs: Sequence[str] = ("prompt", "text"),
) -> DataFrame:
    """Prompt and answer for every test row of a serialized table; only test rows are ever read, and the scorer is given
    the `inputs` columns only."""
    rows = with_prompt(load_serialized(df, style, key, max_examples), dataset)
    answered = batch_score(rows, scorer_factory, {"output": "string"}, batch_size, inputs)
    return answered.drop("text").withColumns(
        {"dataset": F.lit(dataset.name), "serialization": F.lit(style), "model": F.lit(model)}
    )


def _expected(specs: Mapping[str, spec.DatasetSpec]):
    out = F.lit(None).cast("string")
    for name, s in specs.items():
        out = F.when(F.col("dataset") == name, expected_answer(F.col("target_col"), s.positive, s.negative)).otherwise(out)
    return out


def evaluate_answers(df: DataFrame, specs: Mapping[str, spec.DatasetSpec]) -> DataFrame:
    """Every answer with its expected and parsed label, parse status and correctness."""
    parsed = parse_answer(F.col("output"), spec.ANSWER_LABELS)
    return (
        df.withColumns({"expected_prediction": _expected(specs), "__parsed": parsed})
        .withColumns({"parsed_prediction": F.col("__parsed.label"), "parse_status": F.col("__parsed.status")})
        .withColumn("is_correct", is_correct(F.col("expected_prediction"), F.col("parsed_prediction")))
        .drop("__parsed")
    )


def require_known_targets(df: DataFrame, specs: Mapping[str, spec.DatasetSpec]) -> None:
    """Action: raise with the target labels no dataset description knows."""
    bad = df.where(_expected(specs).isNull()).select("target_col").distinct()
    found = [r[0] for r in bad.orderBy("target_col").limit(SHOWN_VALUES + 1).collect()]
    if found:
        more = "" if len(found) <= SHOWN_VALUES else f" and more ({bad.count()} in all)"
        raise ValueError(f"unknown target labels in the answers: {found[:SHOWN_VALUES]}{more}")


def evaluate_responses(df: DataFrame, specs: Mapping[str, spec.DatasetSpec], by: Sequence[str] = BY) -> DataFrame:
    """One result row per run from stored answers, all runs in one aggregation. Invalid answers count as wrong.

    Target labels that no dataset description knows are counted in the same pass and make the result fail.
    """
    negative, positive = spec.ANSWER_LABELS
    by = list(by)
    evaluated = evaluate_answers(df, specs)
    status = F.col("parse_status")
    sums = evaluated.groupBy(*by).agg(
        *metrics.count_columns(F.col("expected_prediction"), F.col("parsed_prediction"), positive, negative),
        F.count_if(status == "non_relevant").alias("non_relevant_responses"),
        F.count_if(status == "ambiguous").alias("ambiguous_responses"),
        F.count_if(F.col("expected_prediction").isNull()).alias("__unknown"),
        F.min(F.when(F.col("expected_prediction").isNull(), F.coalesce("target_col", F.lit("nan")))).alias("__first"),
    )
    found = F.concat(
        F.lit("unknown target labels in the answers: "), F.col("__unknown").cast("string"), F.lit(" rows, first '"), "__first",
        F.lit("'; require_known_targets lists them"),
    )
    # A filter, so that no choice of columns can skip it.
    sums = sums.where(F.when(F.col("__unknown") > 0, F.raise_error(found).cast("boolean")).otherwise(True))
    quality = metrics.metric_columns(fixed_labels=True, prefix="test_")
    invalid = F.col("non_relevant_responses") + F.col("ambiguous_responses")
    target = F.lit(None).cast("string")
    for name, s in specs.items():
        target = F.when(F.col("dataset") == name, F.lit(s.positive)).otherwise(target)
    return sums.select(
        *by,
        F.col("n").alias("n_examples"),
        *[e.alias(c) for c, e in quality.items()],
        F.lit(None).cast("double").alias("test_auc"),
        F.lit(positive).alias("positive_label"),
        target.alias("positive_target_label"),
        responses.percent(invalid, F.col("n")).alias("invalid_response_pct"),
        "non_relevant_responses",
        "ambiguous_responses",
    )


def answer_confusion(df: DataFrame, specs: Mapping[str, spec.DatasetSpec], by: Sequence[str] = BY) -> DataFrame:
    """3 x 3 confusion counts per run, invalid answers included."""
    labels = [*spec.ANSWER_LABELS, spec.INVALID_LABEL]
    return metrics.confusion(evaluate_answers(df, specs), "expected_prediction", "parsed_prediction", labels, by)


CARRIED = ("prediction_time_seconds", "total_examples", "batch_size")


def rebuild_results(
    answers: DataFrame,
    old: DataFrame | None,
    specs: Mapping[str, spec.DatasetSpec],
    order: str | None = None,
) -> DataFrame:
    """All run results from stored answers, with the timings the earlier result table had for the same runs."""
    fresh = evaluate_responses(answers, specs).withColumn("train_time_seconds", F.lit(0.0))
    if old is None:
        return fresh.withColumns({c: F.lit(None).cast("double") for c in CARRIED})
    return results.carry_over(fresh, old, CARRIED, order=order)


def run_answers(
    spark: SparkSession,
    grid: DataFrame,
    make_answers: Callable[[str, str, str], DataFrame],
    specs: Mapping[str, spec.DatasetSpec],
    root: str,
    batch_size: int = 1,
) -> DataFrame:
    """Every run of the grid (dataset, model, serialization) that the log does not hold yet; returns the log's latest rows.

    make_answers(dataset, serialization, model) gives a run's answers. After each run its answers are below
    {root}/answers and its result row is in {root}/log, so that an interrupted loop goes on where it stopped. A stop between
    the two repeats the run, whose answers then replace those already there. A row has all columns that rebuild_results carries.
    """
    log = f"{root.rstrip('/')}/log"
    done = {tuple(r) for r in read_run_log(spark, log).select(*BY).collect()} if path_exists(spark, log) else set()
    for run in grid.select(*BY).orderBy(*BY).collect():
        if tuple(run) in done:
            continue
        started = perf_counter()
        answers = make_answers(run["dataset"], run["serialization"], run["model"])
        place = f"{root.rstrip('/')}/answers"
        meta = write_responses(answers, place, 0, batch_size).drop("total_examples", "n_examples")
        seconds = perf_counter() - started
        mine = F.struct(*BY) == F.struct(*[F.lit(run[c]) for c in BY])
        stored = spark.read.schema(answers.schema).parquet(place).where(mine)
        # A run without any answer has a row too, or it would be run again at every start.
        row = same_key_join(spark.createDataFrame([tuple(run)], grid.select(*BY).schema), evaluate_responses(stored, specs), BY, "left")
        row = same_key_join(row, meta.where(mine), BY, "left").withColumnRenamed("output_file", "raw_responses_file")
        counted = F.coalesce("n_examples", F.lit(0).cast("bigint"))
        extra = {"n_examples": counted, "total_examples": counted, "batch_size": F.lit(batch_size), "prediction_time_seconds": F.lit(seconds)}
        append_run_log(row.withColumns(extra), log)
    return read_run_log(spark, log)
