"""Checks of answer statistics and rebuilt run results."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.inputs import r6
from checks.metrics import BY, EVALUATED_SQL, rounded_metrics
from tabspark import spec
from tabspark.operators import responses as R
from tabspark.operators import results
from tabspark.plans import answers as A

QUERIES, SQL = {}, {}
KEY = list(spec.RESULT_KEY)


def evaluated(s, d):
    return A.evaluate_answers(I.answers(s, d), I.ANSWER_SPECS)


QUERIES["q_evaluated_answers"] = lambda s, d: evaluated(s, d).select(
    "doc_id", *KEY, "expected_prediction", "parsed_prediction", "parse_status", "is_correct"
)
SQL["q_evaluated_answers"] = f"""WITH {I.ANSWERS_SQL} SELECT doc_id, {BY}, expected_prediction, parsed_prediction,
  parse_status, expected_prediction = parsed_prediction AS is_correct FROM ev"""

QUERIES["q_invalid_stats"] = lambda s, d: R.invalid_stats(evaluated(s, d), KEY).withColumn(
    "invalid_response_pct", F.round("invalid_response_pct", 6)
)
SQL["q_invalid_stats"] = f"""WITH {EVALUATED_SQL} SELECT {BY}, n_examples, non_relevant_responses, ambiguous_responses,
  invalid_response_pct FROM rm"""

NAMES = ("positive", "negative", "invalid")
QUERIES["q_answer_distribution"] = lambda s, d: R.answer_distribution(evaluated(s, d), KEY).select(
    *KEY, "n", *NAMES, *[r6(f"{k}_pct") for k in NAMES]
)
_LABEL = {"positive": "positive", "negative": "negative", "invalid": "__invalid__"}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE parsed_prediction = '{_LABEL[k]}') AS {k}" for k in NAMES)
_PCTS = ", ".join(f"round(100.0::DOUBLE * {k} / n, 6) AS {k}_pct" for k in NAMES)
SQL["q_answer_distribution"] = f"""WITH {I.ANSWERS_SQL}, c AS (SELECT {BY}, count(*) AS n, {_COUNTS} FROM ev GROUP BY {BY})
SELECT {BY}, n, {", ".join(NAMES)}, {_PCTS} FROM c"""

QUERIES["q_answer_patterns"] = lambda s, d: R.answer_patterns(I.answers(s, d), KEY, 3).select(
    *KEY, "rank", "n", F.md5(F.coalesce("output", F.lit(""))).alias("answer_hash")
)
SQL["q_answer_patterns"] = f"""WITH {I.ANSWERS_SQL}, c AS (SELECT {BY}, output, count(*) AS n FROM rs GROUP BY {BY}, output)
SELECT {BY}, CAST(rank AS INTEGER) AS rank, n, md5(coalesce(output, '')) AS answer_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY n DESC, output NULLS FIRST) AS rank FROM c) q WHERE rank <= 3"""


def old_results(s, d):
    """An earlier result table of one model, two rows per run; the later row is the valid one."""
    attempt = (F.col("doc_id") % 2).cast("int")
    return (
        I.answers(s, d)
        .where(F.col("model") == "m0")
        .withColumn("attempt", attempt)
        .groupBy(*KEY, "attempt")
        .agg(
            F.round(F.sum("doc_id") / 1000, 3).alias("prediction_time_seconds"),
            F.count("*").alias("total_examples"),
            (F.max("attempt") + 1).alias("batch_size"),
        )
    )


OLD_SQL = f"""old AS (SELECT {BY}, CAST(doc_id % 2 AS INTEGER) AS attempt, round(sum(doc_id) / 1000.0::DOUBLE, 3) AS prediction_time_seconds,
    count(*) AS total_examples, CAST(doc_id % 2 AS INTEGER) + 1 AS batch_size FROM rs WHERE model = 'm0' GROUP BY {BY}, doc_id % 2),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY attempt DESC) AS place FROM old) q WHERE place = 1)"""
CARRIED = ", ".join(A.CARRIED)


def carry_timings(s, d):
    fresh = I.answers(s, d).groupBy(*KEY).agg(F.count("*").alias("n_examples"))
    return results.carry_over(fresh, old_results(s, d), A.CARRIED, order="attempt")


JOIN_SQL = " AND ".join(f"f.{k} = l.{k}" for k in KEY)
QUERIES["q_carry_timings"] = carry_timings
SQL["q_carry_timings"] = f"""WITH {I.ANSWERS_SQL}, {OLD_SQL}, f AS (SELECT {BY}, count(*) AS n_examples FROM rs GROUP BY {BY})
SELECT f.dataset, f.model, f.serialization, n_examples, {CARRIED} FROM f LEFT JOIN latest l ON {JOIN_SQL}"""

QUERIES["q_rebuild_results"] = lambda s, d: rounded_metrics(
    A.rebuild_results(I.answers(s, d), old_results(s, d), I.ANSWER_SPECS, order="attempt")
)
SQL["q_rebuild_results"] = f"""WITH {EVALUATED_SQL}, {OLD_SQL}
SELECT f.*, CAST(0 AS DOUBLE) AS train_time_seconds, {CARRIED} FROM rm f LEFT JOIN latest l ON {JOIN_SQL}"""
