"""Checks of confusion counts, binary metrics, F1, AUC and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.inputs import r6, table
from tabspark import spec
from tabspark.functions.cleaning import threshold
from tabspark.operators import metrics as M
from tabspark.plans import answers as A

QUERIES, SQL = {}, {}


def predicted(s, d):
    return I.scored(s, d).withColumn("pred", threshold(F.col("prob")))


PREDICTED_SQL = f"{I.SCORED_SQL}, pr AS (SELECT *, CAST(prob >= 0.5 AS INTEGER) AS pred FROM sc)"

QUERIES["q_confusion_2"] = lambda s, d: M.confusion(predicted(s, d), "label", "pred", [0, 1], ["o_orderpriority"])
SQL["q_confusion_2"] = f"""WITH {PREDICTED_SQL},
g AS (SELECT p.o_orderpriority, a AS truth, b AS pred FROM (SELECT DISTINCT o_orderpriority FROM pr) p
  CROSS JOIN (SELECT unnest([0, 1]) AS a) x CROSS JOIN (SELECT unnest([0, 1]) AS b) y)
SELECT g.o_orderpriority, g.truth, g.pred, count(pr.label) AS n FROM g LEFT JOIN pr
  ON pr.o_orderpriority = g.o_orderpriority AND pr.label = g.truth AND pr.pred = g.pred GROUP BY 1, 2, 3"""

QUERIES["q_confusion_3"] = lambda s, d: A.answer_confusion(I.answers(s, d), I.ANSWER_SPECS)
SQL["q_confusion_3"] = f"""WITH {I.ANSWERS_SQL},
l AS (SELECT unnest(['negative', 'positive', '__invalid__']) AS x),
g AS (SELECT r.*, a.x AS truth, b.x AS pred FROM (SELECT DISTINCT dataset, model, serialization FROM ev) r
  CROSS JOIN l a CROSS JOIN l b)
SELECT g.dataset, g.model, g.serialization, g.truth, g.pred, count(ev.doc_id) AS n FROM g LEFT JOIN ev
  ON ev.dataset = g.dataset AND ev.model = g.model AND ev.serialization = g.serialization
  AND expected_prediction = g.truth AND parsed_prediction = g.pred GROUP BY ALL"""


def _metric_rows(present_only: bool) -> str:
    return ", ".join(f"round({e}, 6) AS test_{name}" for name, e in I.metrics_sql(present_only).items())


def auc_sql(source: str, by: str) -> str:
    """Rank-sum AUC with average ranks for ties."""
    return f"""SELECT {by}, CASE WHEN p > 0 AND q > 0 THEN (rank_sum - p * (p + 1) / 2.0) / (p * q) END AS auc FROM (
  SELECT {by}, sum(label) AS p, count(*) - sum(label) AS q, sum(CASE WHEN label = 1 THEN mean_rank END) AS rank_sum FROM (
    SELECT {by}, label, low + (ties - 1) / 2.0 AS mean_rank FROM (
      SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY prob) AS low,
        count(*) OVER (PARTITION BY {by}, prob) AS ties FROM {source}) a) b GROUP BY {by}) c"""


def binary_metrics(s, d):
    out = M.binary_metrics(predicted(s, d), "label", "pred", "prob", by=["o_orderpriority"])
    return out.select("o_orderpriority", "n", *[r6(c) for c in spec.QUALITY_METRICS])


QUERIES["q_binary_metrics"] = binary_metrics
SQL["q_binary_metrics"] = f"""WITH {PREDICTED_SQL},
c AS (SELECT o_orderpriority, {I.counts_sql("label", "pred")} FROM pr GROUP BY 1),
a AS ({auc_sql("pr", "o_orderpriority")})
SELECT c.o_orderpriority, n, {_metric_rows(True)}, round(auc, 6) AS test_auc
FROM c JOIN a ON a.o_orderpriority = c.o_orderpriority"""


def missing_keys(s, d):
    """Runs without a serialization, as those of models that read no texts, are runs like any other."""
    rows = predicted(s, d).withColumn("serialization", F.when(F.col("o_orderpriority") > "3", F.col("o_orderpriority")))
    out = M.binary_metrics(rows, "label", "pred", "prob", by=["serialization"])
    return out.select("serialization", "n", *[r6(c) for c in spec.QUALITY_METRICS])


QUERIES["q_missing_keys"] = missing_keys
SQL["q_missing_keys"] = f"""WITH {PREDICTED_SQL},
k AS (SELECT CASE WHEN o_orderpriority > '3' THEN o_orderpriority END AS serialization, label, prob, pred FROM pr),
c AS (SELECT serialization, {I.counts_sql("label", "pred")} FROM k GROUP BY 1),
a AS ({auc_sql("k", "serialization")})
SELECT c.serialization, n, {_metric_rows(True)}, round(auc, 6) AS test_auc
FROM c JOIN a ON a.serialization IS NOT DISTINCT FROM c.serialization"""


def macro_f1(s, d):
    """Both variants; the third label occurs in the predictions only."""
    rows = predicted(s, d).withColumn("pred", F.when(F.col("prob") > 0.9, 2).otherwise(F.col("pred")))
    conf = M.confusion(rows, "label", "pred", [0, 1, 2], ["o_orderpriority"])
    seen = M.macro_f1(conf, by=["o_orderpriority"]).withColumnRenamed("f1_macro", "f1_seen")
    fixed = M.macro_f1(conf, [0, 1], ["o_orderpriority"]).withColumnRenamed("f1_macro", "f1_fixed")
    return seen.join(fixed, "o_orderpriority").select("o_orderpriority", r6("f1_seen"), r6("f1_fixed"))


QUERIES["q_macro_f1"] = macro_f1
SQL["q_macro_f1"] = f"""WITH {I.SCORED_SQL},
pr AS (SELECT o_orderpriority, label, CASE WHEN prob > 0.9 THEN 2 WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc),
f AS (SELECT o_orderpriority, x, 2.0::DOUBLE * count(*) FILTER (WHERE label = x AND pred = x)
    / (count(*) FILTER (WHERE label = x) + count(*) FILTER (WHERE pred = x)) AS f1
  FROM pr CROSS JOIN (SELECT unnest([0, 1, 2]) AS x) l GROUP BY 1, 2)
SELECT o_orderpriority, round(avg(f1), 6) AS f1_seen, round(avg(f1) FILTER (WHERE x < 2), 6) AS f1_fixed FROM f GROUP BY 1"""


def auc(s, d):
    """Prices as scores: nearly all distinct, so the ranges of the ordering matter."""
    rows = table(s, d, "orders").select(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"), "o_totalprice"
    )
    return M.roc_auc(rows, "label", "o_totalprice", ["o_orderpriority"]).select("o_orderpriority", F.round("auc", 8).alias("auc"), "unscored")


QUERIES["q_auc"] = auc
SQL["q_auc"] = f"""WITH pr AS (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  o_totalprice AS prob FROM orders) SELECT o_orderpriority, round(auc, 8) AS auc, CAST(0 AS BIGINT) AS unscored
  FROM ({auc_sql("pr", "o_orderpriority")}) q"""

QUERIES["q_auc_lines"] = lambda s, d: M.roc_auc(
    table(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), "l_extendedprice"),
    "label",
    "l_extendedprice",
).select(F.round("auc", 8).alias("auc"))
SQL["q_auc_lines"] = f"""WITH pr AS (SELECT 1 AS one, CAST(l_returnflag = 'R' AS INTEGER) AS label,
  l_extendedprice AS prob FROM lineitem) SELECT round(auc, 8) AS auc FROM ({auc_sql("pr", "one")}) q"""

QUERIES["q_constant_baseline"] = lambda s, d: M.constant_baselines(I.split_customers(s, d), "target", ["split"]).select(
    "split", "n", "prediction", r6("accuracy"), r6("recall"), r6("f1_macro")
)
SQL["q_constant_baseline"] = f"""WITH {I.CUSTOMERS_SQL},
c AS (SELECT split, prediction, count(*) AS n, count(*) FILTER (WHERE target = prediction) AS hit,
    count(*) FILTER (WHERE target = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE target = 1) AS p
  FROM cu CROSS JOIN (SELECT unnest([0, 1]) AS prediction) b GROUP BY 1, 2)
SELECT split, n, prediction, round(hit / n::DOUBLE, 6) AS accuracy, round(tp / p::DOUBLE, 6) AS recall,
  round(2.0::DOUBLE * hit / (n + hit) / 2, 6) AS f1_macro FROM c"""

BY = ", ".join(spec.RESULT_KEY)
EVALUATED_SQL = f"""{I.ANSWERS_SQL},
er AS (SELECT {BY}, {I.counts_sql("expected_prediction", "parsed_prediction", "'positive'", "'negative'")},
    count(*) FILTER (WHERE parse_status = 'non_relevant') AS non_relevant_responses,
    count(*) FILTER (WHERE parse_status = 'ambiguous') AS ambiguous_responses FROM ev GROUP BY {BY}),
rm AS (SELECT {BY}, n AS n_examples, {_metric_rows(False)}, CAST(NULL AS DOUBLE) AS test_auc,
    'positive' AS positive_label, 'good' AS positive_target_label,
    round(100.0::DOUBLE * (non_relevant_responses + ambiguous_responses) / n, 6) AS invalid_response_pct,
    non_relevant_responses, ambiguous_responses FROM er)"""


def rounded_metrics(df):
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


QUERIES["q_response_metrics"] = lambda s, d: rounded_metrics(A.evaluate_responses(I.answers(s, d), I.ANSWER_SPECS))
SQL["q_response_metrics"] = f"WITH {EVALUATED_SQL} SELECT * FROM rm"
