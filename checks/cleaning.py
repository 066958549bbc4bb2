"""Checks of scans, cleaning, events, splits and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.inputs import DAY_FEATURES, r6, table
from tabspark import spec
from tabspark.functions import cleaning as C
from tabspark.operators import clean, events, prepare, split
from tabspark.plans.prepare import prepare_attribute_table, prepare_diabetes
from tabspark.sources import readers

QUERIES, SQL = {}, {}


def rounded_sql(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- scans -------------------------------------------------------------------
POSITIONS = {0: "first_token", 3: "fourth_token", 7: "last_token"}
SPLIT_SQL = r"list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+'), lambda t: t <> '')"

QUERIES["q_token_blocks"] = lambda s, d: readers.token_blocks(table(s, d, "documents"), "text", ["doc_id"], 8, POSITIONS)
SQL["q_token_blocks"] = f"""WITH t AS (SELECT doc_id, {SPLIT_SQL} AS w FROM documents),
p AS (SELECT doc_id, len(w) // 8 AS full_blocks, unnest(w) AS token, unnest(range(len(w))) AS place FROM t)
SELECT doc_id, CAST(place // 8 AS INTEGER) AS block, max(token) FILTER (WHERE place % 8 = 0) AS first_token,
  max(token) FILTER (WHERE place % 8 = 3) AS fourth_token, max(token) FILTER (WHERE place % 8 = 7) AS last_token
FROM p WHERE place // 8 < full_blocks GROUP BY 1, 2"""

QUERIES["q_validate_split"] = lambda s, d: readers.validate_split(I.split_customers(s, d))
SQL["q_validate_split"] = f"""WITH {I.CUSTOMERS_SQL}
SELECT split, count(*) AS n, CAST(max(CAST(target = 0 AS INTEGER)) + max(CAST(target = 1 AS INTEGER)) AS INTEGER) AS classes,
  count(*) FILTER (WHERE target IS NULL) AS missing, count(*) FILTER (WHERE target NOT IN (0, 1)) AS foreign
FROM cu GROUP BY split"""

STATUS_SPEC = spec.DatasetSpec(name="orders", target="o_orderstatus", target_labels={"F": "filled", "O": "open"})


def codebook_join(s, d):
    book = readers.codebook_table(s, [STATUS_SPEC])
    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    joined = clean.join_codebook(orders, book, F.col("o_orderstatus"), "orders", "o_orderstatus")
    return joined.groupBy("label", "ord").agg(F.count("*").alias("n"))


QUERIES["q_codebook_join"] = codebook_join
SQL["q_codebook_join"] = """SELECT coalesce(label, 'unknown') AS label, ord, count(*) AS n FROM orders
LEFT JOIN (VALUES ('F', 'filled', 0), ('O', 'open', 1)) b(code, label, ord) ON o_orderstatus = code GROUP BY 1, 2"""

EVENT_SPEC = spec.DatasetSpec(
    name="events", target="none", categories={"event_type": {"click": "look", "view": "look", "purchase": "act"}}
)


def code_dimension(s, d):
    book = readers.codebook_table(s, [EVENT_SPEC])
    joined = clean.join_codebook(table(s, d, "events").select("event_type", "value"), book, F.col("event_type"), "events", "event_type")
    return joined.groupBy(F.col("label").alias("code_group")).agg(
        F.count("*").alias("n"), F.round(F.avg("ord"), 6).alias("level"), F.round(F.sum("value"), 4).alias("total")
    )


QUERIES["q_code_dim"] = code_dimension
SQL["q_code_dim"] = """SELECT coalesce(label, 'unknown') AS code_group, count(*) AS n, round(avg(ord), 6) AS level,
  round(sum(value), 4) AS total
FROM events LEFT JOIN (VALUES ('click', 'look', 0), ('view', 'look', 1), ('purchase', 'act', 2)) b(code, label, ord)
  ON event_type = code GROUP BY 1"""

# --- cleaning ----------------------------------------------------------------


def sentinel_null(s, d):
    size = C.null_if(F.col("p_size").cast("string"), "1", "50")
    return table(s, d, "part").groupBy("p_brand").agg(
        F.count_if(size.isNull()).alias("missing"), F.count(size).alias("present")
    )


QUERIES["q_sentinel_null"] = sentinel_null
SQL["q_sentinel_null"] = """SELECT p_brand, count(*) FILTER (WHERE p_size IN (1, 50)) AS missing,
  count(*) FILTER (WHERE p_size NOT IN (1, 50)) AS present FROM part GROUP BY 1"""


def to_numeric(s, d):
    digits = F.regexp_extract("props", r": (\d+)", 1)
    text = F.when(I.every(5), F.concat(digits, F.lit("d"))).when(I.every(7), F.concat(digits, F.lit("e1"))).otherwise(
        F.concat(F.lit("  "), digits)
    )
    number = C.to_numeric(text)
    return table(s, d, "events").groupBy("event_type").agg(
        F.count(number).alias("numbers"),
        F.count_if(number.isNull()).alias("missing"),
        F.sum(number).alias("total"),
        F.sum(C.to_int_code(text)).alias("code_total"),
    )


QUERIES["q_to_numeric"] = to_numeric
SQL["q_to_numeric"] = r"""WITH t AS (SELECT event_type, CAST(regexp_extract(props, ': (\d+)', 1) AS DOUBLE) AS k,
    event_id % 5 = 0 AS bad, event_id % 7 = 0 AS tens FROM events),
u AS (SELECT event_type, CASE WHEN bad THEN NULL WHEN tens THEN k * 10 ELSE k END AS x FROM t)
SELECT event_type, count(x) AS numbers, count(*) - count(x) AS missing, sum(x) AS total,
  CAST(sum(CAST(x AS BIGINT)) AS BIGINT) AS code_total FROM u GROUP BY 1"""


def clean_events(s, d):
    return I.clean_log(s, d).groupBy("code").agg(
        F.count("*").alias("n"),
        F.count("value").alias("n_value"),
        F.round(F.sum("value"), 4).alias("total"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


QUERIES["q_clean_events"] = clean_events
SQL["q_clean_events"] = f"""WITH {I.LOG_SQL} SELECT CAST(code AS INTEGER) AS code, count(*) AS n, count(value) AS n_value,
  round(sum(value), 4) AS total, min(day) AS first_day, max(day) AS last_day FROM log GROUP BY 1"""


def parse_ts(s, d):
    at = C.parse_ts(F.col("date"), F.col("time"))
    return I.raw_log(s, d).groupBy("patient_id").agg(
        F.count(at).alias("parsed"),
        F.count_if(at.isNull()).alias("missing"),
        F.date_format(F.min(at), "yyyy-MM-dd HH:mm").alias("first_at"),
        F.date_format(F.max(at), "yyyy-MM-dd HH:mm").alias("last_at"),
    )


QUERIES["q_parse_ts"] = parse_ts
SQL["q_parse_ts"] = """SELECT user_id AS patient_id, count(*) FILTER (WHERE event_id % 19 <> 0) AS parsed,
  count(*) FILTER (WHERE event_id % 19 = 0) AS missing,
  strftime(min(ts) FILTER (WHERE event_id % 19 <> 0), '%Y-%m-%d %H:%M') AS first_at,
  strftime(max(ts) FILTER (WHERE event_id % 19 <> 0), '%Y-%m-%d %H:%M') AS last_at
FROM events GROUP BY 1"""


def binarize(s, d):
    urgent = C.binarize(F.substring("o_orderpriority", 1, 1).cast("int"), above=2)
    dear = C.binarize(F.floor(F.col("o_totalprice") / 300000).cast("int") + 1, mapping={1: 1, 2: 0})
    return table(s, d, "orders").select(urgent.alias("low_priority"), dear.alias("cheap")).groupBy("low_priority", "cheap").agg(
        F.count("*").alias("n")
    )


QUERIES["q_binarize"] = binarize
SQL["q_binarize"] = """SELECT CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) > 2 AS INTEGER) AS low_priority,
  CASE CAST(floor(o_totalprice / 300000) AS INTEGER) + 1 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS cheap, count(*) AS n
FROM orders GROUP BY 1, 2"""


def recode(s, d):
    return clean.recode(I.attributes(s, d), {"nation": I.NATIONS}).groupBy("nation").agg(
        F.count("*").alias("n"), F.round(F.sum("bal"), 4).alias("total")
    )


_NATION_CASE = "CASE CAST(nation AS INTEGER) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in I.NATIONS.items()) + " ELSE 'unknown' END"
QUERIES["q_recode"] = recode
SQL["q_recode"] = f"""WITH {I.ATTRIBUTES_SQL} SELECT {_NATION_CASE} AS nation, count(*) AS n, round(sum(bal), 4) AS total
FROM cu0 GROUP BY 1"""

QUERIES["q_unmapped_targets"] = lambda s, d: clean.unmapped(
    table(s, d, "orders"), "o_orderpriority", {"1-URGENT": "yes", "5-LOW": "no"}, F.col("o_orderpriority")
)
SQL["q_unmapped_targets"] = """SELECT DISTINCT o_orderpriority AS value FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')"""


def nearest_level(s, d):
    days = I.daily(s, d)
    named = clean.recode_levels(days, {"meal_pattern": spec.LEVELS, "exercise_pattern": spec.LEVELS})
    return named.groupBy("meal_pattern", "exercise_pattern").agg(F.count("*").alias("n"))


def _level_case(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} <= 0.5 THEN 'less' WHEN {c} <= 1.5 THEN 'typical' ELSE 'more' END"


QUERIES["q_nearest_level"] = nearest_level
SQL["q_nearest_level"] = f"""WITH {I.DAILY_SQL} SELECT {_level_case("meal_pattern")} AS meal_pattern,
  {_level_case("exercise_pattern")} AS exercise_pattern, count(*) AS n FROM daily GROUP BY 1, 2"""


def expected(s, d):
    return I.answers(s, d).groupBy("dataset", "target_col", C.expected_answer(F.col("target_col"), "good", "bad").alias("expected")).agg(
        F.count("*").alias("n")
    )


QUERIES["q_expected_answer"] = expected
SQL["q_expected_answer"] = f"""WITH {I.ANSWERS_SQL} SELECT dataset, target_col,
  CASE target_col WHEN 'good' THEN 'positive' WHEN 'bad' THEN 'negative' END AS expected, count(*) AS n
FROM rs GROUP BY 1, 2, 3"""

QUERIES["q_threshold"] = lambda s, d: (
    I.scored(s, d).select("label", C.threshold(F.col("prob")).alias("pred")).groupBy("label", "pred").agg(F.count("*").alias("n"))
)
SQL["q_threshold"] = f"WITH {I.SCORED_SQL} SELECT label, CAST(prob >= 0.5 AS INTEGER) AS pred, count(*) AS n FROM sc GROUP BY 1, 2"


def positive_prob(s, d):
    p = F.col("prob")
    return I.scored(s, d).groupBy("o_orderpriority").agg(
        F.round(F.sum(C.positive_prob(F.array(1 - p, p), (0, 1))), 4).alias("in_order"),
        F.round(F.sum(C.positive_prob(F.array(p, 1 - p), (1, 0))), 4).alias("reversed"),
    )


QUERIES["q_positive_prob"] = positive_prob
SQL["q_positive_prob"] = f"""WITH {I.SCORED_SQL} SELECT o_orderpriority, round(sum(prob), 4) AS in_order,
  round(sum(prob), 4) AS reversed FROM sc GROUP BY 1"""

# --- events ------------------------------------------------------------------
QUERIES["q_daily_features"] = lambda s, d: I.daily(s, d).select("patient_id", "day", *map(r6, DAY_FEATURES))
SQL["q_daily_features"] = f"WITH {I.DAILY_SQL} SELECT patient_id, day, {rounded_sql(DAY_FEATURES)} FROM daily"

QUERIES["q_next_day_label"] = lambda s, d: I.labelled(s, d).select("patient_id", "day", "target")
SQL["q_next_day_label"] = f"WITH {I.LABELLED_SQL} SELECT patient_id, day, target FROM labelled"


def next_event_label(s, d):
    """Every event labelled from the user's next one: records per user without a calendar bound, hence bucketed."""
    log = table(s, d, "events").select(
        "event_id", "user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").cast("int").alias("is_error")
    )
    out = events.next_record_label(log, "user_id", "at", "is_error", bucket=F.date_trunc("hour", F.col("at.ts")))
    return out.select("event_id", "user_id", "target")


QUERIES["q_next_event_label"] = next_event_label
SQL["q_next_event_label"] = """SELECT event_id, user_id, CAST(following AS INTEGER) AS target FROM (
  SELECT event_id, user_id, lead(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following
  FROM events) e WHERE following IS NOT NULL"""

# --- splits ------------------------------------------------------------------
QUERIES["q_stratified_split"] = lambda s, d: I.split_customers(s, d).select("c_custkey", "target", "split")
SQL["q_stratified_split"] = f"WITH {I.CUSTOMERS_SQL} SELECT c_custkey, target, split FROM cu"

QUERIES["q_group_split"] = lambda s, d: I.split_days(s, d).groupBy("patient_id", "split").agg(
    F.count("*").alias("days"), F.sum("target").alias("positives")
)
SQL["q_group_split"] = f"""WITH {I.SPLIT_DAYS_SQL} SELECT patient_id, split, count(*) AS days,
  CAST(sum(target) AS BIGINT) AS positives FROM split_days GROUP BY 1, 2"""


def split_disjoint(s, d):
    days = I.split_days(s, d)
    shared = split.split_overlap(days, "patient_id").agg(F.count("*").alias("patients")).select(F.lit("both").alias("split"), "patients")
    return days.groupBy("split").agg(F.count_distinct("patient_id").alias("patients")).unionByName(shared)


QUERIES["q_split_disjoint"] = split_disjoint
SQL["q_split_disjoint"] = f"""WITH {I.SPLIT_DAYS_SQL}
SELECT split, count(DISTINCT patient_id) AS patients FROM split_days GROUP BY split
UNION ALL SELECT 'both', count(*) FROM (
  SELECT patient_id FROM split_days GROUP BY 1 HAVING count(DISTINCT split) > 1) b"""

QUERIES["q_stratified_folds"] = lambda s, d: split.stratified_folds(table(s, d, "orders"), "o_orderkey", "o_orderstatus").groupBy(
    "o_orderstatus", "fold"
).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))
SQL["q_stratified_folds"] = """WITH r AS (SELECT o_orderkey, o_orderstatus,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42')) AS place FROM orders),
c AS (SELECT o_orderstatus AS c, n, coalesce(sum(n) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) q),
f AS (SELECT c, k, sum((off + n - k + 4) // 5 - (off - k + 4) // 5) OVER (PARTITION BY c ORDER BY k) AS upto
  FROM c CROSS JOIN (SELECT unnest(range(5)) AS k) ks)
SELECT o_orderstatus, CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (
  SELECT r.o_orderkey, r.o_orderstatus, min(f.k) AS fold FROM r JOIN f ON f.c = r.o_orderstatus AND r.place <= f.upto GROUP BY 1, 2) x
GROUP BY 1, 2"""

# --- preparation -------------------------------------------------------------
QUERIES["q_class_balance"] = lambda s, d: prepare.class_balance(I.split_customers(s, d), ["split"], "target").select(
    "split", "target", "n", r6("share")
)
SQL["q_class_balance"] = f"""WITH {I.CUSTOMERS_SQL} SELECT split, target, count(*) AS n,
  round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE), 6) AS share FROM cu GROUP BY 1, 2"""


def label_share(s, d):
    days = I.split_days(s, d).select(F.lit("events").alias("dataset"), "split", "target")
    customers = I.split_customers(s, d).select(F.lit("customer").alias("dataset"), "split", "target")
    return prepare.label_share(days.unionByName(customers), "dataset", "target").select("dataset", r6("train"), r6("test"))


QUERIES["q_label_share"] = label_share
SQL["q_label_share"] = f"""WITH {I.SPLIT_DAYS_SQL}, {I.CUSTOMERS_SQL},
b AS (SELECT 'events' AS dataset, split, target FROM split_days UNION ALL SELECT 'customer', split, target FROM cu)
SELECT dataset, round(avg(CAST(target = 1 AS INTEGER)) FILTER (WHERE split = 'train'), 6) AS train,
  round(avg(CAST(target = 1 AS INTEGER)) FILTER (WHERE split = 'test'), 6) AS test FROM b GROUP BY 1"""


def impute_mode(s, d):
    t = I.split_customers(s, d)
    return prepare.impute(t, prepare.fit_modes(t, ["seg", "nation"])).select("c_custkey", "seg", "nation")


_MODE = "(SELECT {c} FROM cu WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
QUERIES["q_impute_mode"] = impute_mode
SQL["q_impute_mode"] = f"""WITH {I.CUSTOMERS_SQL} SELECT c_custkey, coalesce(seg, {_MODE.format(c="seg")}) AS seg,
  coalesce(nation, {_MODE.format(c="nation")}) AS nation FROM cu"""


def impute_mean(s, d):
    t = I.split_customers(s, d)
    return prepare.impute(t, prepare.fit_means(t, ["bal", "level"])).select("c_custkey", r6("bal"), r6("level"))


_MEAN = "(SELECT avg({c}) FROM cu WHERE split = 'train')"
QUERIES["q_impute_mean"] = impute_mean
SQL["q_impute_mean"] = f"""WITH {I.CUSTOMERS_SQL} SELECT c_custkey, round(coalesce(bal, {_MEAN.format(c="bal")}), 6) AS bal,
  round(coalesce(level, {_MEAN.format(c="level")}), 6) AS level FROM cu"""


def standardize(s, d):
    t = I.split_customers(s, d).withColumn("same", F.lit(3.0))
    return prepare.scale(t, prepare.fit_scaler(t, ["bal", "same"])).select("c_custkey", r6("bal"), r6("same"))


QUERIES["q_standardize"] = standardize
SQL["q_standardize"] = f"""WITH {I.CUSTOMERS_SQL}
SELECT c_custkey, round((bal - {_MEAN.format(c="bal")}) / (SELECT stddev_pop(bal) FROM cu WHERE split = 'train'), 6) AS bal,
  CAST(0 AS DOUBLE) AS same FROM cu"""


def prepare_events(s, d):
    out = prepare_diabetes(I.raw_log(s, d)).scaled
    return out.select("patient_id", "day", "split", "target", *map(r6, DAY_FEATURES))


def _z(c: str) -> str:
    sd = f"(SELECT stddev_pop({c}) FROM filled WHERE split = 'train')"
    return (
        f"round(({c} - (SELECT avg({c}) FROM filled WHERE split = 'train')) / CASE WHEN {sd} = 0 THEN 1 ELSE {sd} END, 6) AS {c}"
    )


def _day_fill(c: str) -> str:
    if c in spec.DIABETES_ZERO_FILLED:
        return c
    return f"coalesce({c}, (SELECT avg({c}) FROM split_days WHERE split = 'train')) AS {c}"


QUERIES["q_prepare_events"] = prepare_events
SQL["q_prepare_events"] = f"""WITH {I.SPLIT_DAYS_SQL},
filled AS (SELECT patient_id, day, split, target, {", ".join(map(_day_fill, DAY_FEATURES))} FROM split_days)
SELECT patient_id, day, split, target, {", ".join(map(_z, DAY_FEATURES))} FROM filled"""


def prepare_attributes(s, d):
    out = prepare_attribute_table(I.attributes(s, d), "c_custkey", ["seg", "nation"], ["bal", "level"])
    return out.scaled.select("c_custkey", "split", "target", "seg", "nation", r6("bal"), r6("level"))


QUERIES["q_prepare_attributes"] = prepare_attributes
SQL["q_prepare_attributes"] = f"""WITH {I.CUSTOMERS_SQL}, filled AS (SELECT c_custkey, split, target,
    coalesce(seg, {_MODE.format(c="seg")}) AS seg, coalesce(nation, {_MODE.format(c="nation")}) AS nation,
    coalesce(bal, {_MEAN.format(c="bal")}) AS bal, coalesce(level, {_MEAN.format(c="level")}) AS level FROM cu)
SELECT c_custkey, split, target, seg, nation, {_z("bal")}, {_z("level")} FROM filled"""

QUERIES["q_event_names"] = lambda s, d: clean.name_events(I.clean_log(s, d)).groupBy("code", "event").agg(F.count("*").alias("n"))
SQL["q_event_names"] = f"""WITH {I.LOG_SQL} SELECT CAST(code AS INTEGER) AS code, CASE code {" ".join(f"WHEN {k} THEN '{v}'" for k, v in spec.EVENT_CODES.items())} END AS event,
  count(*) AS n FROM log GROUP BY 1, 2"""
