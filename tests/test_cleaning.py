import pytest
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.functions import cleaning as C
from tabspark.operators import clean, events

TEXTS = ["1", " 2.5 ", "-9", "-9.0", "3A", "0Hi", "1d", "", None, "1e3", ".5", "5.", "nan", "inf", "0x1A", "+4"]
NUMBERS = [1.0, 2.5, -9.0, -9.0, None, None, None, None, None, 1000.0, 0.5, 5.0, None, float("inf"), None, 4.0]


def one(spark, column, **values):
    """Value of an expression over a single row."""
    kinds = {str: "string", float: "double", int: "int", type(None): "string", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_coercing_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(C.to_numeric(F.col("t"))).collect()] == NUMBERS


def test_sentinel_is_an_exact_text(spark):
    df = spark.createDataFrame([("-9",), ("-9.0",), ("?",), (None,)], "t string")
    got = [r[0] for r in df.select(C.to_numeric(C.null_if(F.col("t"), "-9", "?"))).collect()]
    assert got == [None, -9.0, None, None]


def test_strict_numbers_fail(spark):
    assert one(spark, C.to_numeric_strict(F.col("t")), t="2.5") == 2.5
    assert one(spark, C.to_numeric_strict(F.col("t")), t=None) is None
    with pytest.raises(Exception, match="not a number"):
        one(spark, C.to_numeric_strict(F.col("t")), t="x")


def test_codes_truncate_toward_zero(spark):
    assert one(spark, C.to_int_code(F.col("t")), t="33.9") == 33
    assert one(spark, C.to_int_code(F.col("t")), t="-1.9") == -1


def test_timestamps(spark):
    df = spark.createDataFrame(
        [("04-21-1991", "9:09"), ("4-1-1991", "23:59"), ("06-31-1991", "7:00"), (None, "7:00"), ("04-21-1991", "24:61")],
        "d string, t string",
    )
    got = [r[0] and r[0].strftime("%Y-%m-%d %H:%M") for r in df.select(C.parse_ts(F.col("d"), F.col("t"))).collect()]
    assert got == ["1991-04-21 09:09", "1991-04-01 23:59", None, None, None]


@pytest.mark.parametrize(
    "value, label",
    [(0.4, "less"), (0.5, "less"), (0.6, "typical"), (1.5, "typical"), (1.51, "more"), (None, "unknown"), (9.0, "more")],
)
def test_nearest_level(spark, value, label):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(C.nearest_level(F.col("x"), spec.LEVELS)).first()[0] == label


def test_category_labels(spark):
    book = {"1": "male", "2": "female"}
    assert one(spark, C.category_label(F.col("t"), book), t="1.0") == "male"
    assert one(spark, C.category_label(F.col("t"), book), t="?") == "unknown"
    assert one(spark, C.category_label(F.col("t"), book), t=None) == "unknown"
    assert one(spark, C.category_label(F.col("t"), book), t="9") == "unknown"


def test_positive_probability_needs_two_classes(spark):
    df = spark.createDataFrame([([0.2, 0.8],)], "p array<double>")
    assert df.select(C.positive_prob(F.col("p"), (0, 1))).first()[0] == 0.8
    assert df.select(C.positive_prob(F.col("p"), (1, 0))).first()[0] == 0.2
    with pytest.raises(ValueError):
        C.positive_prob(F.col("p"), (0, 1, 2))
    with pytest.raises(ValueError):
        C.positive_prob(F.col("p"), (0, 2))
    with pytest.raises(Exception, match="two classes"):
        spark.createDataFrame([([0.2],)], "p array<double>").select(C.positive_prob(F.col("p"), (0, 1))).collect()


def test_threshold_includes_the_bound(spark):
    assert one(spark, C.threshold(F.col("p")), p=0.5) == 1
    assert one(spark, C.threshold(F.col("p")), p=0.4999) == 0


def test_unmapped_targets_are_listed_sorted(spark):
    df = spark.createDataFrame([("1",), ("7",), ("3",), ("7",), (None,)], "target string")
    with pytest.raises(ValueError, match=r"\['3', '7', 'nan'\]"):
        clean.recode_target(df, "target", {"0": "a", "1": "b"})
    kept = clean.recode_target(df.where("target = '1'"), "target", {"0": "a", "1": "b"})
    assert kept.columns == ["target_col"] and kept.first()[0] == "b"


LOG = [
    # date, time, code, value, patient
    ("04-21-1991", "9:09", "58", "100", 1),
    ("04-21-1991", "12:00", "33", "9", 1),
    ("04-21-1991", "17:00", "33", "0Hi", 1),
    ("04-21-1991", "18:00", "3A", "5", 1),
    ("04-21-1991", "19:00", "22", "5", 1),
    ("06-31-1991", "9:00", "58", "77", 1),
    ("04-25-1991", "8:00", "65", None, 1),
    ("04-25-1991", "9:00", "60", "90", 1),
    ("04-25-1991", "10:00", "62", "110", 1),
    ("04-25-1991", "11:00", "66", "0", 1),
    ("04-25-1991", "12:00", "67", "0", 1),
    ("04-28-1991", "8:00", "34", "3", 1),
    ("04-21-1991", "8:00", "58", "50", 2),
]


def daily(spark):
    raw = spark.createDataFrame(LOG, "date string, time string, code string, value string, patient_id int")
    log = clean.clean_events(raw).withColumn("day", C.day_of(F.col("datetime")))
    return events.daily_features(
        log, ["patient_id", "day"], "code", "value",
        spec.DIABETES_SUMS, spec.DIABETES_STATS, spec.DIABETES_EVENTS, spec.DIABETES_ORDINALS,
    )


def test_daily_features(spark):
    first, second, third, other = [r.asDict() for r in daily(spark).orderBy("patient_id", "day").collect()]
    assert (first["insulin_regular_total"], first["insulin_regular_doses"]) == (9.0, 1.0)
    assert (first["glucose_mean"], first["glucose_std"], first["glucose_count"]) == (100.0, None, 1.0)
    assert first["insulin_nph_total"] == 0.0 and first["hypoglycemic_events"] == 0.0 and first["meal_pattern"] is None
    assert second["hypoglycemic_events"] == 1.0 and second["meal_pattern"] == 1.5
    assert second["glucose_std"] == pytest.approx(14.142135623730951)
    assert third["glucose_mean"] is None and third["glucose_count"] == 0.0
    assert other["glucose_min"] == 50.0


def test_label_is_from_the_next_record_not_the_next_day(spark, rows):
    labelled = events.next_record_label(daily(spark), "patient_id", "day", "hypoglycemic_events")
    assert [(r[0], r[1].day, r[-1]) for r in rows(labelled, "day")] == [(1, 21, 1), (1, 25, 0)]


def test_bucketed_label_equals_the_plain_window(spark, rows):
    """One entity holds a third of all rows; buckets of ten cut its records into many groups."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17 + 1).alias("k"),
        (F.col("id") * 7919 % 3001).alias("o"),
        (F.col("id") * 31 % 5 - 2).alias("x"),
    )
    plain = events.next_record_label(df, "k", "o", "x")
    bucketed = events.next_record_label(df, "k", "o", "x", bucket=F.floor(F.col("o") / 10))
    assert rows(plain, "k", "o") == rows(bucketed, "k", "o")
