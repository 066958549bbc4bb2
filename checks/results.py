"""Checks of result tables: upsert, union, grid, labels, texts, rankings, spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.inputs import r6, table
from tabspark import spec
from tabspark.functions.display import cell_text, model_label, percent_text
from tabspark.functions.text import py_float_str
from tabspark.operators import metrics as M
from tabspark.operators import results as R
from tabspark.operators.prepare import class_balance
from tabspark.operators.split import stratified_folds
from tabspark.plans.benchmark import compare_results, label_results

QUERIES, SQL = {}, {}
NUMBERS = [*spec.QUALITY_METRICS, *spec.TIME_METRICS]
KEY = list(spec.RESULT_KEY)
KEY_SQL = ", ".join(KEY)


def upsert(s, d):
    runs = I.runs(s, d).select(*KEY, "approach", "attempt", *NUMBERS)
    again = runs.where("attempt = 1 AND model IN ('alpha', 'xgboost', 'tarte')")
    return R.upsert(runs.where("attempt = 0"), again, [*KEY, "approach"])


QUERIES["q_upsert"] = upsert
SQL["q_upsert"] = f"""WITH {I.RUNS_SQL}, r AS (SELECT {KEY_SQL}, approach, attempt, {", ".join(NUMBERS)} FROM runs),
again AS (SELECT * FROM r WHERE attempt = 1 AND model IN ('alpha', 'xgboost', 'tarte'))
SELECT * FROM again UNION ALL SELECT * FROM r WHERE attempt = 0 AND NOT EXISTS (SELECT 1 FROM again a WHERE
  a.dataset = r.dataset AND a.model = r.model AND a.serialization = r.serialization AND a.approach IS NOT DISTINCT FROM r.approach)"""

QUERIES["q_dataset_list"] = lambda s, d: R.dataset_list(I.runs(s, d))
SQL["q_dataset_list"] = f"WITH {I.RUNS_SQL} SELECT DISTINCT dataset FROM runs"


def result_frames(s, d):
    """Three result tables as separate programs would write them: other columns, numbers as text."""
    runs = I.runs(s, d)
    trees = runs.where(F.col("source").isin("xgboost", "lightgbm", "my_new_model")).drop("serialization", "approach")
    texts = (
        runs.where(F.col("source") == "tabllm")
        .drop("test_auc", "approach")
        .withColumn("test_precision", F.coalesce(F.when(F.col("test_precision") > 0.5, F.col("test_precision")).cast("string"), F.lit("n/a")))
    )
    encoder = runs.where(F.col("source") == "tarte").drop("serialization").withColumn("test_recall", F.lit(float("nan")))
    return [trees, texts, encoder]


TEXTS = ["dataset", "source", "model", "serialization", "approach"]
FRAMES_SQL = f"""{I.RUNS_SQL}, merged AS (SELECT dataset, source, model,
    CASE WHEN source = 'tabllm' THEN serialization END AS serialization, approach, test_f1_macro, test_accuracy,
    CASE WHEN source <> 'tabllm' OR test_precision > 0.5 THEN test_precision END AS test_precision,
    CASE WHEN source <> 'tarte' THEN test_recall END AS test_recall, test_auc, train_time_seconds, prediction_time_seconds
  FROM runs)"""
QUERIES["q_union_align"] = lambda s, d: R.union_align(result_frames(s, d), TEXTS, NUMBERS)
SQL["q_union_align"] = f"WITH {FRAMES_SQL} SELECT * FROM merged"


def run_grid(s, d):
    """Rows per cell of the grid models x datasets x styles, cells without any row included."""
    orders = table(s, d, "orders")
    lists = {c: sorted(r[0] for r in orders.select(c).distinct().collect()) for c in ("o_orderpriority", "o_orderstatus")}
    grid = R.run_grid(s, lists["o_orderpriority"], lists["o_orderstatus"], I.STYLES)
    done = (
        orders.where(~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")))
        .groupBy(
            F.col("o_orderpriority").alias("model"),
            F.col("o_orderstatus").alias("dataset"),
            I.pick(F.col("o_orderkey") % 3, *I.STYLES).alias("serialization"),
        )
        .agg(F.count("*").alias("n"))
    )
    return grid.join(done, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


QUERIES["q_run_grid"] = run_grid
SQL["q_run_grid"] = f"""WITH g AS (SELECT DISTINCT o_orderpriority AS model, dataset, serialization FROM orders
  CROSS JOIN (SELECT DISTINCT o_orderstatus AS dataset FROM orders) x
  CROSS JOIN (SELECT unnest([{", ".join(f"'{x}'" for x in I.STYLES)}]) AS serialization) y),
o AS (SELECT o_orderpriority, o_orderstatus, [{", ".join(f"'{x}'" for x in I.STYLES)}][o_orderkey % 3 + 1] AS style
  FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P'))
SELECT dataset, model, serialization, count(style) AS n FROM g
LEFT JOIN o ON o_orderpriority = model AND o_orderstatus = dataset AND style = serialization GROUP BY 1, 2, 3"""

LABEL_SQL = """CASE source WHEN 'tabllm' THEN 'TabLLM: ' || model || ' [' || serialization || ']'
  WHEN 'tarte' THEN CASE WHEN approach IS NULL THEN 'TARTE' ELSE 'TARTE: ' || approach END
  WHEN 'xgboost' THEN 'XGBoost' WHEN 'lightgbm' THEN 'LightGBM' ELSE 'My New Model' END"""


def labels(s, d):
    name = model_label(F.col("source"), F.col("model"), F.col("serialization"), F.col("approach"))
    return I.runs(s, d).select("dataset", name.alias("model_label"), "attempt", "test_accuracy")


QUERIES["q_model_label"] = labels
SQL["q_model_label"] = f"WITH {I.RUNS_SQL} SELECT dataset, {LABEL_SQL} AS model_label, attempt, test_accuracy FROM runs"


def texts(s, d):
    cells = [cell_text(F.col(c), "metric").alias(c) for c in ("test_f1_macro", "test_accuracy", "test_auc")]
    times = [cell_text(F.col(c), "time").alias(c) for c in spec.TIME_METRICS]
    return I.runs(s, d).select(*I.RUN_COLUMNS, *cells, *times)


QUERIES["q_cell_text"] = texts
_METRIC_TEXT = ", ".join(f"coalesce(format('{{:.3f}}', {c}), '-') AS {c}" for c in ("test_f1_macro", "test_accuracy", "test_auc"))
_TIME_TEXT = ", ".join(
    f"CASE WHEN {c} IS NULL THEN '-' WHEN {c} <= 0 THEN '0 s' ELSE format('{{:.3g}}', {c}) || ' s' END AS {c}" for c in spec.TIME_METRICS
)
SQL["q_cell_text"] = f"WITH {I.RUNS_SQL} SELECT {', '.join(I.RUN_COLUMNS)}, {_METRIC_TEXT}, {_TIME_TEXT} FROM runs"


def line_texts(s, d):
    """Display texts of every line's numbers: price as a time, discount as a metric."""
    return table(s, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        cell_text(F.col("l_extendedprice") / 997, "time").alias("time_text"),
        cell_text(F.col("l_discount") * F.col("l_quantity") / 7, "metric").alias("metric_text"),
        percent_text(F.col("l_quantity") / 53).alias("percent"),
    )


QUERIES["q_line_texts"] = line_texts
SQL["q_line_texts"] = """SELECT l_orderkey, l_linenumber, format('{:.3g}', l_extendedprice / 997) || ' s' AS time_text,
  format('{:.3f}', l_discount * l_quantity / 7) AS metric_text, format('{:.1f}', l_quantity / 53 * 100) || '%' AS percent
FROM lineitem"""

LABELLED_SQL = f"""{FRAMES_SQL}, named AS (SELECT *, {LABEL_SQL} AS model_label FROM merged),
av AS (SELECT dataset, model_label, {", ".join(f"avg({c}) AS {c}" for c in NUMBERS)} FROM named GROUP BY 1, 2)"""


def ranked(s, d):
    return compare_results(label_results(result_frames(s, d)))


QUERIES["q_results_rank"] = lambda s, d: ranked(s, d).select("dataset", "model_label", "quality_rank", *map(r6, NUMBERS))
SQL["q_results_rank"] = f"""WITH {LABELLED_SQL} SELECT dataset, model_label, CAST(row_number() OVER (PARTITION BY dataset
  ORDER BY test_f1_macro DESC NULLS LAST, model_label) AS INTEGER) AS quality_rank,
  {", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS)} FROM av"""

QUERIES["q_runtime_rank"] = lambda s, d: ranked(s, d).select("dataset", "model_label", "runtime_rank", r6("total_runtime_seconds"))
SQL["q_runtime_rank"] = f"""WITH {LABELLED_SQL}, t AS (SELECT *, train_time_seconds + prediction_time_seconds AS total FROM av)
SELECT dataset, model_label, CAST(row_number() OVER (PARTITION BY dataset ORDER BY total NULLS LAST, model_label) AS INTEGER)
  AS runtime_rank, round(total, 6) AS total_runtime_seconds FROM t"""

QUERIES["q_time_spread"] = lambda s, d: (
    R.time_spread(I.runs(s, d).where(F.col("source") == "tabllm"), ["dataset", "model", "attempt"], "serialization")
    .withColumn("spread", F.round("spread", 6))
)
SQL["q_time_spread"] = f"""WITH {I.RUNS_SQL}, t AS (SELECT *, prediction_time_seconds AS t FROM runs WHERE source = 'tabllm')
SELECT dataset, model, attempt, round(max(t) - min(t), 6) AS spread,
  first(serialization ORDER BY t, serialization) AS fastest, first(serialization ORDER BY t DESC, serialization) AS slowest
FROM t WHERE t IS NOT NULL GROUP BY 1, 2, 3"""

QUERIES["q_time_range"] = lambda s, d: R.time_range(I.runs(s, d), ["dataset", "source"]).select(
    "dataset", "source", r6("time_min"), r6("time_max")
)
SQL["q_time_range"] = f"""WITH {I.RUNS_SQL}, t AS (SELECT dataset, source, train_time_seconds AS t FROM runs
  UNION ALL SELECT dataset, source, prediction_time_seconds FROM runs),
m AS (SELECT dataset, source, min(t) FILTER (WHERE t > 0) AS low, max(t) FILTER (WHERE t > 0) AS high FROM t GROUP BY 1, 2)
SELECT dataset, source, round(CASE WHEN low = high THEN low / 10 ELSE low END, 6) AS time_min,
  round(CASE WHEN low = high THEN high * 10 ELSE high END, 6) AS time_max FROM m"""


def best_config(s, d):
    """Order priorities as configurations, scored on stratified folds."""
    rows = I.scored(s, d).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    folded = stratified_folds(rows, "o_orderkey", "label")
    scores = M.binary_metrics(folded, "label", "pred", by=["o_orderpriority", "fold"], prefix="")
    # One more configuration whose scores are missing: it must not win.
    lost = scores.where(F.col("o_orderpriority") == "5-LOW").withColumns(
        {"o_orderpriority": F.lit("0-NONE"), "f1_macro": F.lit(None).cast("double")}
    )
    return R.best_config(scores.unionByName(lost), "o_orderpriority").select("o_orderpriority", r6("f1_macro"), r6("accuracy"), r6("precision"), r6("recall"))


_M = I.metrics_sql(present_only=True)
QUERIES["q_best_config"] = best_config
SQL["q_best_config"] = f"""WITH {I.SCORED_SQL},
r AS (SELECT *, CAST(prob >= 0.5 AS INTEGER) AS pred,
    row_number() OVER (PARTITION BY label ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42')) AS place FROM sc),
c AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT label, count(*) AS n FROM sc GROUP BY 1) q),
f AS (SELECT label, k, sum((off + n - k + 4) // 5 - (off - k + 4) // 5) OVER (PARTITION BY label ORDER BY k) AS upto
  FROM c CROSS JOIN (SELECT unnest(range(5)) AS k) ks),
x AS (SELECT r.o_orderkey, o_orderpriority, r.label, pred, min(f.k) AS fold FROM r
  JOIN f ON f.label = r.label AND r.place <= f.upto GROUP BY ALL),
t AS (SELECT o_orderpriority, fold, {I.counts_sql("label", "pred")} FROM x GROUP BY 1, 2),
m AS (SELECT o_orderpriority, {", ".join(f"avg({_M[k]}) AS {k}" for k in ("f1_macro", "accuracy", "precision", "recall"))}
  FROM t GROUP BY 1)
SELECT o_orderpriority, round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall FROM m ORDER BY m.f1_macro DESC, o_orderpriority LIMIT 1"""


def share_text(s, d):
    shares = class_balance(table(s, d, "lineitem"), ["l_suppkey"], "l_returnflag")
    return shares.select("l_suppkey", "l_returnflag", "n", percent_text(F.col("share")).alias("share_text"))


QUERIES["q_share_text"] = share_text
SQL["q_share_text"] = """SELECT l_suppkey, l_returnflag, n,
  format('{:.1f}', n / CAST(sum(n) OVER (PARTITION BY l_suppkey) AS DOUBLE) * 100) || '%' AS share_text
FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) q"""


def wide_numbers(s, d):
    """Prices spread from 1e-12 to 1e20, with an infinity, as display texts and as Python's number text."""
    value = F.when(F.col("o_orderkey") % 97 == 0, F.lit(float("inf"))).otherwise(
        F.col("o_totalprice") * F.element_at(F.array(*[F.lit(x) for x in SCALES]), (F.col("o_orderkey") % len(SCALES) + 1).cast("int"))
    )
    return table(s, d, "orders").select(
        "o_orderkey",
        cell_text(value, "time").alias("time_text"),
        cell_text(value, "metric").alias("metric_text"),
        py_float_str(value).cast("double").alias("back"),
    )


SCALES = [1e-17, 1e-12, 1e-9, 1e-6, 1e-3, 1.0, 1e3, 1e6, 1e10, 1e14]
QUERIES["q_wide_texts"] = wide_numbers
SQL["q_wide_texts"] = f"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN CAST('inf' AS DOUBLE)
  ELSE o_totalprice * CAST([{", ".join(f"'{x!r}'" for x in SCALES)}][o_orderkey % {len(SCALES)} + 1] AS DOUBLE) END AS v FROM orders)
SELECT o_orderkey, format('{{:.3g}}', v) || ' s' AS time_text, format('{{:.3f}}', v) AS metric_text, v AS back FROM v"""
