import pytest
from pyspark.sql import functions as F

from tabspark.operators import metrics as M
from tabspark.operators import prepare as P

# (tp, fp, tn, fn), accuracy %, recall %, macro F1 as printed in the published tables
GOLDEN = [
    ((25, 6, 714, 76), 90.01, 24.75, 0.662),
    ((23, 8, 712, 78), 89.52, 22.77, 0.646),
    ((24, 6, 714, 77), 89.89, 23.76, 0.656),
    ((23, 3, 717, 78), 90.13, 22.77, 0.654),
    ((20, 2, 718, 81), 89.89, 19.80, 0.635),
    ((19, 4, 28, 7), 81.03, 73.08, 0.806),
    ((20, 5, 27, 6), 81.03, 76.92, 0.808),
    ((20, 7, 25, 6), 77.59, 76.92, 0.774),
    ((21, 4, 28, 5), 84.48, 80.77, 0.843),
    ((4, 3, 22, 2), 83.87, 66.67, 0.757),
    ((3, 3, 22, 3), 80.65, 50.00, 0.690),
    ((5, 3, 22, 1), 87.10, 83.33, 0.815),
    ((4, 2, 23, 2), 87.10, 66.67, 0.793),
    ((3, 2, 23, 3), 83.87, 50.00, 0.724),
]


def test_published_metrics(spark):
    rows = []
    for run, ((tp, fp, tn, fn), *_) in enumerate(GOLDEN):
        rows += [(run, 1, 1)] * tp + [(run, 0, 1)] * fp + [(run, 0, 0)] * tn + [(run, 1, 0)] * fn
    out = M.binary_metrics(spark.createDataFrame(rows, "run int, t int, p int"), "t", "p", by=["run"])
    for r in out.collect():
        _, accuracy, recall, f1 = GOLDEN[r["run"]]
        assert round(100 * r["test_accuracy"], 2) == accuracy
        assert round(100 * r["test_recall"], 2) == recall
        assert round(r["test_f1_macro"], 3) == f1
        assert r["test_auc"] is None


@pytest.mark.parametrize(
    "negatives, positives, always_0, always_1",
    [(720, 101, (87.70, 0.467), None), (32, 26, (55.17, 0.356), (44.83, 0.310)), (25, 6, (80.65, 0.446), (19.35, 0.162))],
)
def test_published_baselines(spark, negatives, positives, always_0, always_1):
    df = spark.range(negatives + positives).select((F.col("id") < positives).cast("int").alias("t"))
    found = {r["prediction"]: r for r in M.constant_baselines(df, "t").collect()}
    for prediction, want in ((0, always_0), (1, always_1)):
        if want:
            assert (round(100 * found[prediction]["accuracy"], 2), round(found[prediction]["f1_macro"], 3)) == want
    assert found[0]["recall"] == 0.0 and found[1]["recall"] == 1.0


def test_no_positive_prediction_and_one_class(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.9)], "t int, p int, s double")
    row = M.binary_metrics(df, "t", "p", "s").first()
    assert row["test_precision"] == 0.0 and row["test_recall"] == 0.0 and row["test_auc"] is None
    assert row["test_f1_macro"] == 1.0  # only label 0 occurs
    assert M.binary_metrics(df, "t", "p", "s", fixed_labels=True).first()["test_f1_macro"] == 0.5


def test_confusion_has_every_cell(spark, rows):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "t int, p int")
    assert rows(M.confusion(df, "t", "p", [0, 1, 2]), "truth", "pred") == [
        (0, 0, 1), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 1, 2), (1, 2, 0), (2, 0, 0), (2, 1, 0), (2, 2, 0),
    ]


def brute_auc(pairs):
    pos = [s for t, s in pairs if t]
    neg = [s for t, s in pairs if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [1, 7, 1024])
def test_auc_equals_brute_force(spark, ranges):
    """A third of the scores are one value; the rest has ties, infinities and crowds near zero."""
    pairs = [(int(i * 31 % 7 < 3), 0.5 if i % 3 == 0 else (i * 37 % 101) / 10 ** (i % 9)) for i in range(900)]
    pairs += [(1, float("inf")), (0, float("-inf")), (0, float("inf"))]
    df = spark.createDataFrame(pairs, "t int, s double")
    assert M.roc_auc(df, "t", "s", rows=-(-len(pairs) // ranges)).first()["auc"] == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_auc_by_run(spark):
    pairs = [(i % 4, int(i * 13 % 5 < 2), (i * 29 % 97) / 97) for i in range(800)]
    found = {r["run"]: r["auc"] for r in M.roc_auc(spark.createDataFrame(pairs, "run int, t int, s double"), "t", "s", ["run"]).collect()}
    for run in range(4):
        assert found[run] == pytest.approx(brute_auc([(t, s) for r, t, s in pairs if r == run]), abs=1e-12)


def test_mode_is_the_smallest_on_ties(spark):
    df = spark.createDataFrame(
        [("2", 2.0, "train"), ("1", 10.0, "train"), (None, None, "train"), ("9", 9.0, "test"), ("9", 9.0, "test"), (None, None, "test")],
        "a string, b double, split string",
    )
    fills = P.fit_modes(df, ["a", "b"])
    assert fills == {"a": "1", "b": 2.0}
    assert [tuple(r) for r in P.impute(df, fills).where("split = 'test'").collect()][-1] == ("1", 2.0, "test")


def test_scaler_uses_population_deviation_of_the_training_rows(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, "train"), (2.0, 5.0, "train"), (3.0, 5.0, "train"), (9.0, 6.0, "test")], "a double, b double, split string"
    )
    stats = P.fit_scaler(df, ["a", "b"])
    assert stats["a"] == (2.0, pytest.approx(0.816496580927726)) and stats["b"] == (5.0, 1.0)
    scaled = P.scale(df, stats)
    assert scaled.where("split = 'test'").first()["b"] == 1.0
    train = scaled.where("split = 'train'").agg(F.avg("a"), F.stddev_pop("a")).first()
    assert train[0] == pytest.approx(0) and train[1] == pytest.approx(1)


def test_all_missing_column_stays_missing(spark):
    df = spark.createDataFrame([(None, "train")], "a double, split string")
    assert P.impute(df, P.fit_imputer(df, num=["a"])).first()["a"] is None


def test_missing_scores_are_reported(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (0, 0.1, 0), (1, None, 1)], "t int, s double, p int")
    assert tuple(M.roc_auc(df, "t", "s").first()) == (1.0, 1)
    with pytest.raises(Exception, match="have no score"):
        M.binary_metrics(df, "t", "p", "s").collect()


def test_missing_keys_are_keys(spark):
    from tabspark.operators.results import carry_over

    rows = [("d", "m", None, 1, 0.9), ("d", "m", None, 0, 0.1), ("d", "n", "json", 1, 0.2), ("d", "n", "json", 0, 0.2)]
    by = ["dataset", "model", "serialization"]
    df = spark.createDataFrame(rows, "dataset string, model string, serialization string, y int, p double").withColumn("pred", (F.col("p") > 0.5).cast("int"))
    found = {r["serialization"]: r["test_auc"] for r in M.binary_metrics(df, "y", "pred", "p", by=by).collect()}
    assert found == {None: 1.0, "json": 0.5}
    gap = df.withColumn("p", F.when(F.col("serialization").isNotNull(), F.col("p")))
    with pytest.raises(Exception, match="rows have no score"):
        M.binary_metrics(gap, "y", "pred", "p", by=by).collect()
    old = spark.createDataFrame([("d", "m", None, 7.0)], "dataset string, model string, serialization string, t double")
    new = df.select(*by).distinct().withColumn("t", F.lit(0.0))
    assert {r["serialization"]: r["t"] for r in carry_over(new, old, ["t"], by).collect()} == {None: 7.0, "json": None}
