"""Inputs several checks share, once as a DataFrame and once as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.functions import cleaning as C
from tabspark.operators.clean import clean_events
from tabspark.operators.events import daily_features, next_record_label
from tabspark.operators.metrics import count_columns, metric_columns
from tabspark.operators.split import group_split, stratified_split
from tabspark.staging import staged


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def every(n: int, key: str = "event_id"):
    return F.col(key) % n == 0


def pick(number, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


# --- event log ---------------------------------------------------------------
# The events table as a raw text log with the defects the cleaning rules are for.


def raw_log(spark: SparkSession, folder: str) -> DataFrame:
    third = (F.col("event_id") % 3).cast("int")
    kind = F.col("event_type")
    code = (
        F.when(every(23), "3A")
        .when(every(29), "22")
        .when(kind == "click", F.when(every(2), "58").otherwise("62"))
        .when(kind == "view", (third + 66).cast("string"))
        .when(kind == "purchase", (third + 33).cast("string"))
        .when(kind == "signup", (third + 69).cast("string"))
        .otherwise("65")
    )
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("patient_id"),
        F.when(every(19), "06-31-1991").otherwise(F.date_format("ts", "M-d-yyyy")).alias("date"),
        F.date_format("ts", "H:m").alias("time"),
        code.alias("code"),
        F.when(every(17), "0Hi").otherwise(F.col("value").cast("string")).alias("value"),
    )


def clean_log(spark: SparkSession, folder: str) -> DataFrame:
    return clean_events(raw_log(spark, folder)).withColumn("day", C.day_of(F.col("datetime")))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return daily_features(
        clean_log(spark, folder),
        ["patient_id", "day"],
        "code",
        "value",
        spec.DIABETES_SUMS,
        spec.DIABETES_STATS,
        spec.DIABETES_EVENTS,
        spec.DIABETES_ORDINALS,
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return next_record_label(daily(spark, folder), "patient_id", "day", "hypoglycemic_events")


def split_days(spark: SparkSession, folder: str) -> DataFrame:
    return group_split(staged(labelled(spark, folder)), "patient_id")


LOG_SQL = """log AS (
  SELECT event_id, user_id AS patient_id, date_trunc('minute', ts) AS datetime, CAST(ts AS DATE) AS day,
    CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 58 ELSE 62 END
      WHEN 'view' THEN 66 + event_id % 3 WHEN 'purchase' THEN 33 + event_id % 3
      WHEN 'signup' THEN 69 + event_id % 3 ELSE 65 END AS code,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value
  FROM events WHERE event_id % 23 <> 0 AND event_id % 29 <> 0 AND event_id % 19 <> 0)"""


def _sum_sql(name: str, code: int) -> str:
    return (
        f"coalesce(sum(value) FILTER (WHERE code = {code}), 0.0) AS {name}_total,"
        f" CAST(count(value) FILTER (WHERE code = {code}) AS DOUBLE) AS {name}_doses"
    )


def _level_sql(name: str, levels: dict) -> str:
    cases = " ".join(f"WHEN {code} THEN {level}" for code, level in levels.items())
    return f"avg(CASE code {cases} END) AS {name}"


_GLUCOSE = ", ".join(str(c) for c in spec.DIABETES_STATS["glucose"])
_STATS_SQL = ", ".join(
    f"{fn}(value) FILTER (WHERE code IN ({_GLUCOSE})) AS glucose_{name}"
    for name, fn in {"mean": "avg", "min": "min", "max": "max", "std": "stddev_samp"}.items()
)
DAILY_SQL = f"""{LOG_SQL}, daily AS (
  SELECT patient_id, day, {", ".join(_sum_sql(n, c) for n, c in spec.DIABETES_SUMS.items())},
    {_STATS_SQL}, CAST(count(value) FILTER (WHERE code IN ({_GLUCOSE})) AS DOUBLE) AS glucose_count,
    CAST(count(*) FILTER (WHERE code = 65) AS DOUBLE) AS hypoglycemic_events,
    {", ".join(_level_sql(n, m) for n, m in spec.DIABETES_ORDINALS.items())}
  FROM log GROUP BY patient_id, day)"""
LABELLED_SQL = f"""{DAILY_SQL}, labelled AS (
  SELECT * EXCLUDE (following), CAST(following > 0 AS INTEGER) AS target FROM (
    SELECT *, lead(hypoglycemic_events) OVER (PARTITION BY patient_id ORDER BY day) AS following FROM daily) d
  WHERE following IS NOT NULL)"""
SPLIT_DAYS_SQL = f"""{LABELLED_SQL}, groups AS (
  SELECT patient_id, row_number() OVER (ORDER BY md5(CAST(patient_id AS VARCHAR) || ':42')) AS place,
    count(*) OVER () AS n FROM (SELECT DISTINCT patient_id FROM labelled) g),
split_days AS (
  SELECT l.*, CASE WHEN g.place <= ceil(0.2 * g.n) THEN 'test' ELSE 'train' END AS split
  FROM labelled l JOIN groups g ON l.patient_id = g.patient_id)"""
DAY_FEATURES = [
    "insulin_regular_total", "insulin_regular_doses", "insulin_nph_total", "insulin_nph_doses",
    "insulin_ultralente_total", "insulin_ultralente_doses", "glucose_mean", "glucose_min", "glucose_max",
    "glucose_std", "glucose_count", "hypoglycemic_events", "meal_pattern", "exercise_pattern",
]

# --- attribute table ---------------------------------------------------------
NATIONS = {"0": "north", "1": "south", "2": "east", "3": "west", "7": "coast"}
CUSTOMER = spec.DatasetSpec(
    name="customer",
    target_labels={"0": "far", "1": "near"},
    categories={"nation": NATIONS},
    levels={"level": spec.LEVELS},
    numeric=("bal",),
    drop=("c_custkey", "no_such_column"),
    task="Predict whether the customer lives near.",
    positive="near",
)


def attributes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.when(key % 11 != 0, F.col("c_mktsegment")).alias("seg"),
        F.when(key % 7 != 0, F.col("c_nationkey").cast("double")).alias("nation"),
        F.when(key % 5 != 0, (key % 9) / 4).alias("level"),
        F.when(key % 13 != 0, F.col("c_acctbal")).alias("bal"),
        C.binarize(6 - F.col("c_nationkey"), above=0).alias("target"),
    )


def split_customers(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_split(attributes(spark, folder), "c_custkey", "target")


ATTRIBUTES_SQL = """cu0 AS (
  SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS seg,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS nation,
    CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 9) / 4.0::DOUBLE END AS level,
    CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS bal,
    CAST(c_nationkey < 6 AS INTEGER) AS target
  FROM customer)"""


def split_sql(source: str, key: str, label: str, name: str) -> str:
    """Plain form of the stratified split: rank by hash inside each class, sizes by largest remainder."""
    return f"""{name}_n AS (SELECT {label} AS c, count(*) AS n FROM {source} GROUP BY 1),
{name}_x AS (SELECT c, n * w / t AS x, floor(n * w / t) AS base, w FROM (
  SELECT c, n, CAST(sum(n) OVER () AS DOUBLE) AS t, ceil(0.2 * sum(n) OVER ()) AS w FROM {name}_n) q),
{name}_t AS (SELECT c, base + CASE WHEN row_number() OVER (ORDER BY x - base DESC, c) <= w - sum(base) OVER ()
  THEN 1 ELSE 0 END AS take FROM {name}_x),
{name} AS (SELECT s.* EXCLUDE (place), CASE WHEN place <= take THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({key} AS VARCHAR) || ':42')) AS place
  FROM {source}) s JOIN {name}_t ON {label} = c)"""


CUSTOMERS_SQL = f"{ATTRIBUTES_SQL}, {split_sql('cu0', 'c_custkey', 'target', 'cu')}"

# --- scored test set ---------------------------------------------------------


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        ((F.col("o_orderkey") * 37 % 101) / 100).alias("prob"),
    )


SCORED_SQL = """sc AS (
  SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
    ((o_orderkey * 37) % 101) / 100.0::DOUBLE AS prob FROM orders)"""

# --- stored answers ----------------------------------------------------------
MODELS = ("m0", "m1")
STYLES = tuple(spec.STYLE_COLUMNS)
ANSWER_SPECS = {
    name: spec.DatasetSpec(name=name, target_labels={"0": "bad", "1": "good"}, positive="good", task="Judge the text.")
    for name in ("plain", "toxic")
}
WORDS = ("Positive.", "negative", "NEGATIVE!", '{"positive": true}', "positive or negative?", "no idea")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every labelled document answered by two models in three styles; the last style repeats the whole document."""
    texts = table(spark, folder, "documents").select("doc_id", "text")
    runs = (
        table(spark, folder, "labels")
        .join(texts, "doc_id")
        .select("*", F.posexplode(F.array(*map(F.lit, MODELS))).alias("m", "model"))
        .select("*", F.posexplode(F.array(*map(F.lit, STYLES))).alias("s", "serialization"))
    )
    turn = ((F.col("doc_id") + 3 * F.col("m") + 5 * F.col("s")) % 7).cast("int")
    word = pick(turn, *WORDS, None)
    return runs.select(
        "doc_id",
        F.when(F.col("toxic") == 1, "toxic").otherwise("plain").alias("dataset"),
        "model",
        "serialization",
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("target_col"),
        F.when(F.col("s") == 2, F.concat(word, F.lit(" "), F.col("text"))).otherwise(word).alias("output"),
    )


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ANSWERS_SQL = f"""rs AS (
  SELECT doc_id, dataset, model, serialization, target_col,
    CASE WHEN s = 2 THEN word || ' ' || text ELSE word END AS output
  FROM (SELECT l.doc_id, d.text, m, s, 'm' || m AS model, [{", ".join(map(_quote, STYLES))}][s + 1] AS serialization,
      CASE WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END AS dataset,
      CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS target_col,
      CASE (l.doc_id + 3 * m + 5 * s) % 7 {" ".join(f"WHEN {i} THEN {_quote(w)}" for i, w in enumerate(WORDS))} END AS word
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id
      CROSS JOIN (SELECT unnest([0, 1]) AS m) ms CROSS JOIN (SELECT unnest([0, 1, 2]) AS s) ss) q),
norm AS (SELECT *, ' ' || trim(regexp_replace(lower(coalesce(output, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM rs),
ev AS (SELECT * EXCLUDE (t, p, n),
    CASE WHEN target_col = 'good' THEN 'positive' ELSE 'negative' END AS expected_prediction,
    CASE WHEN p AND NOT n THEN 'positive' WHEN n AND NOT p THEN 'negative' ELSE '__invalid__' END AS parsed_prediction,
    CASE WHEN p AND n THEN 'ambiguous' WHEN p OR n THEN 'parsed' ELSE 'non_relevant' END AS parse_status
  FROM (SELECT *, t LIKE '% positive %' AS p, t LIKE '% negative %' AS n FROM norm) q)"""

# --- result tables -----------------------------------------------------------
# Orders grouped into runs: status = dataset, priority = kind of model, two attempts per configuration.
SOURCES = {"1-URGENT": "xgboost", "2-HIGH": "lightgbm", "3-MEDIUM": "tabllm", "4-NOT SPECIFIED": "tarte"}
RUN_COLUMNS = ["dataset", "source", "model", "serialization", "approach", "attempt"]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    source = C.lookup(F.col("o_orderpriority"), SOURCES, "my_new_model")
    marked = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("dataset"),
        source.alias("source"),
        F.when(source == "tabllm", F.when(customer % 2 == 0, "alpha").otherwise("beta")).otherwise(source).alias("model"),
        F.when(source == "tabllm", pick(key % 3, *STYLES)).otherwise("none").alias("serialization"),
        F.when((source == "tarte") & (customer % 2 == 0), "encoder").alias("approach"),
        F.expr("o_orderkey div 7 % 2").cast("int").alias("attempt"),
        (F.col("o_totalprice") >= 250000).cast("int").alias("truth"),
        C.threshold(key * 37 % 101 / 100).alias("pred"),
        "o_totalprice",
        "o_custkey",
    )
    measured = marked.groupBy(*RUN_COLUMNS).agg(
        *count_columns(F.col("truth"), F.col("pred")),
        F.round(F.avg("o_totalprice") / 100000, 3).alias("train_seconds"),
        F.round(F.avg("o_custkey") / 1000, 3).alias("predict_seconds"),
    )
    m = metric_columns(fixed_labels=False)
    is_text = F.col("source") == "tabllm"
    return measured.select(
        *RUN_COLUMNS,
        F.when(~((F.col("source") == "my_new_model") & (F.col("dataset") == "P")), F.round(m["f1_macro"], 2)).alias("test_f1_macro"),
        F.round(m["accuracy"], 4).alias("test_accuracy"),
        F.round(m["precision"], 4).alias("test_precision"),
        F.round(m["recall"], 4).alias("test_recall"),
        F.when(~is_text, F.round(F.col("tp") / F.col("n"), 4)).alias("test_auc"),
        F.when(is_text, 0.0)
        .when(~((F.col("source") == "tarte") & (F.col("dataset") == "O")), F.col("train_seconds"))
        .alias("train_time_seconds"),
        F.when(
            ~((F.col("source") == "lightgbm") & (F.col("dataset") == "F") & (F.col("attempt") == 1)), F.col("predict_seconds")
        ).alias("prediction_time_seconds"),
    )


def metrics_sql(present_only: bool) -> dict[str, str]:
    """Binary metrics over columns tp, fp, tn, fn, neg_fp, neg_fn, n."""
    pos = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"
    neg = "coalesce(2.0::DOUBLE * tn / nullif(2 * tn + neg_fp + neg_fn, 0), 0)"
    present = "(CAST(tp + fp + fn > 0 AS INTEGER) + CAST(tn + neg_fp + neg_fn > 0 AS INTEGER))" if present_only else "2"
    return {
        "f1_macro": f"coalesce(({pos} + {neg}) / nullif({present}, 0), 0)",
        "accuracy": "coalesce((tp + tn)::DOUBLE / nullif(n, 0), 0)",
        "precision": "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)",
        "recall": "coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)",
    }


def counts_sql(truth: str, pred: str, positive: str = "1", negative: str = "0") -> str:
    cells = {
        "tp": f"{truth} = {positive} AND {pred} = {positive}",
        "fp": f"{truth} <> {positive} AND {pred} = {positive}",
        "tn": f"{truth} = {negative} AND {pred} = {negative}",
        "fn": f"{truth} = {positive} AND {pred} <> {positive}",
        "neg_fp": f"{truth} <> {negative} AND {pred} = {negative}",
        "neg_fn": f"{truth} = {negative} AND {pred} <> {negative}",
    }
    return "count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in cells.items())


_M = metrics_sql(present_only=True)
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCES.items())
RUNS_SQL = f"""marked AS (
  SELECT o_orderstatus AS dataset, source,
    CASE WHEN source = 'tabllm' THEN CASE WHEN o_custkey % 2 = 0 THEN 'alpha' ELSE 'beta' END ELSE source END AS model,
    CASE WHEN source = 'tabllm' THEN [{", ".join(map(_quote, STYLES))}][o_orderkey % 3 + 1] ELSE 'none' END AS serialization,
    CASE WHEN source = 'tarte' AND o_custkey % 2 = 0 THEN 'encoder' END AS approach,
    CAST((o_orderkey // 7) % 2 AS INTEGER) AS attempt,
    CAST(o_totalprice >= 250000 AS INTEGER) AS truth,
    CAST(((o_orderkey * 37) % 101) / 100.0::DOUBLE >= 0.5 AS INTEGER) AS pred, o_totalprice, o_custkey
  FROM (SELECT *, CASE o_orderpriority {_CASES} ELSE 'my_new_model' END AS source FROM orders) o),
measured AS (SELECT {", ".join(RUN_COLUMNS)}, {counts_sql("truth", "pred")},
    round(avg(o_totalprice) / 100000, 3) AS train_seconds, round(avg(o_custkey) / 1000, 3) AS predict_seconds
  FROM marked GROUP BY {", ".join(RUN_COLUMNS)}),
runs AS (SELECT {", ".join(RUN_COLUMNS)},
    CASE WHEN NOT (source = 'my_new_model' AND dataset = 'P') THEN round({_M["f1_macro"]}, 2) END AS test_f1_macro,
    round({_M["accuracy"]}, 4) AS test_accuracy, round({_M["precision"]}, 4) AS test_precision,
    round({_M["recall"]}, 4) AS test_recall,
    CASE WHEN source <> 'tabllm' THEN round(tp::DOUBLE / n, 4) END AS test_auc,
    CASE WHEN source = 'tabllm' THEN 0.0 WHEN NOT (source = 'tarte' AND dataset = 'O') THEN train_seconds END
      AS train_time_seconds,
    CASE WHEN NOT (source = 'lightgbm' AND dataset = 'F' AND attempt = 1) THEN predict_seconds END
      AS prediction_time_seconds
  FROM measured)"""
