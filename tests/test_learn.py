import pytest
from pyspark.sql import functions as F

from checks import learning
from tabspark import spec
from tabspark.operators.learn import DEPTH_GRID, HashedTrees, TunedTrees, batch_score, grid_points
from tabspark.operators.metrics import confusion
from tabspark.operators.split import stratified_folds, stratified_split
from tabspark.plans.answers import answer_job, evaluate_responses
from tabspark.plans.benchmark import evaluate, fit_and_score, run_benchmark, tuned_result


def separable(spark, n=400):
    df = spark.range(n).select(
        "id", (F.col("id") % 10 / 10).alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 10 >= 6).cast("int").alias("target")
    )
    return stratified_split(df, "id", "target")


def test_the_evaluation_check_chooses_from_the_whole_grid(monkeypatch):
    monkeypatch.setattr(learning, "days", lambda s, d: None)
    monkeypatch.setattr(learning, "judged", lambda table, model: model)
    assert learning.QUERIES["q_evaluate"](None, None).points == grid_points(DEPTH_GRID)


def test_tuned_trees(spark):
    table = separable(spark)
    model = TunedTrees(["a", "b"], "target", {"maxDepth": [1, 2], "stepSize": [0.1]}, maxIter=2)
    with pytest.raises(RuntimeError):
        _ = model.best_parameters
    model.fit(stratified_folds(table.where("split = 'train'"), "id", "target", 2))
    assert model.scores.count() == 4 and set(model.best_parameters) == {"maxDepth", "stepSize"}
    assert model.cross_validation_metrics()["f1_macro"] > 0.9
    scored = model.score(table.where("split = 'test'"))
    assert scored.where("prob between 0 and 1").count() == 80


def test_tuned_trees_make_their_own_folds(spark):
    model = TunedTrees(["a", "b"], "target", {"maxDepth": [2]}, key="id", folds=2, maxIter=1)
    out = tuned_result(evaluate(separable(spark), model), model).first()
    assert out["train_f1_macro"] > 0.9 and "maxDepth" in out["best_parameters"]
    assert {r["fold"] for r in model.scores.collect()} == {0, 1}


def test_folds_need_a_key(spark):
    with pytest.raises(ValueError, match="key"):
        TunedTrees(["a", "b"], "target", {"maxDepth": [2]}).fit(separable(spark).where("split = 'train'"))


def test_encoder_trees_in_a_benchmark(spark):
    table = separable(spark).drop("id")
    families = {"hashed": lambda t: HashedTrees(["a", "b"], "target", maxIter=3)}
    out = run_benchmark({"d": table}, families).first()
    assert (out["dataset"], out["source"]) == ("d", "hashed") and out["test_f1_macro"] > 0.9 and out["test_auc"] > 0.9
    assert out["train_time_seconds"] > 0 and out["prediction_time_seconds"] > 0


class Rule:
    """Any object with fit and score is a model."""

    def fit(self, train):
        assert "split" not in train.columns
        return self

    def score(self, test):
        return test.withColumn("prob", F.col("a"))


def test_plug_in_model(spark):
    assert evaluate(separable(spark), Rule()).first()["test_auc"] == 1.0
    cells = confusion(fit_and_score(separable(spark), Rule()).rows, "target", "pred", [0, 1])
    assert sum(r["n"] for r in cells.collect()) == 80


def test_grid_points():
    assert grid_points({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_batches_are_bounded_and_the_scorer_is_made_once_per_task(spark):
    def factory():
        seen = []

        def score(frame):
            seen.append(len(frame))
            return {"size": [len(frame)] * len(frame), "calls": [len(seen)] * len(frame)}

        return score

    df = spark.range(0, 1000, 1, 2)
    out = batch_score(df, factory, {"size": "int", "calls": "int"}, 150)
    assert out.count() == 1000
    top = out.agg(F.max("size"), F.max("calls"), F.count_distinct("id")).first()
    assert tuple(top) == (150, 4, 1000)
    with pytest.raises(ValueError):
        batch_score(df, factory, {"size": "int"}, 0)


def test_answer_job_reads_test_rows_only(spark):
    rows = [(i, "test" if i % 5 == 0 else "train", f"The a is {i}.", "heart disease" if i % 2 else "no heart disease") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, split string, serialized_text string, target_col string")

    def factory():
        return lambda frame: {"output": ["positive" if int(t.split()[-1][:-1]) % 2 else "Negative." for t in frame["text"]]}

    out = answer_job(df, spec.HEART, "text_template", "rule", factory, "k", batch_size=4)
    assert out.count() == 10 and set(out.columns) >= {"output", "prompt", "dataset", "serialization", "model"}
    assert evaluate_responses(out, spec.DATASETS).first()["test_accuracy"] == 1.0
    assert answer_job(df, spec.HEART, "text_template", "rule", factory, "k", max_examples=3).count() == 3


def test_unknown_targets_fail_in_the_evaluation(spark):
    rows = [("heart", "m", "s", "no heart disease", "negative"), ("heart", "m", "s", "strange", "positive")]
    df = spark.createDataFrame(rows, "dataset string, model string, serialization string, target_col string, output string")
    with pytest.raises(Exception, match="unknown target labels"):
        evaluate_responses(df, spec.DATASETS).select("test_accuracy").collect()


def test_the_run_loop_goes_on_where_it_stopped(spark, tmp_path):
    from tabspark.operators.results import run_grid
    from tabspark.plans.answers import run_answers

    made = []

    def make(dataset, style, model):
        if len(made) == 1 and not (tmp_path / "again").exists():
            raise RuntimeError("stopped")
        made.append(model)
        rows = [(dataset, style, model, label, "positive") for label in spec.HEART.target_labels.values()]
        return spark.createDataFrame(rows, "dataset string, serialization string, model string, target_col string, output string")

    grid = run_grid(spark, ["m0", "m1", "m2"], ["heart"], ["json"])
    with pytest.raises(RuntimeError):
        run_answers(spark, grid, make, spec.DATASETS, f"{tmp_path}/runs")
    (tmp_path / "again").write_text("")
    out = run_answers(spark, grid, make, spec.DATASETS, f"{tmp_path}/runs").collect()
    assert made == ["m0", "m1", "m2"] and sorted(r["model"] for r in out) == made
    assert all(r["n_examples"] == 2 and r["test_accuracy"] == 0.5 for r in out)


def test_hashed_rows_of_one_file_go_to_several_tasks(spark, monkeypatch):
    from tabspark.operators import learn

    given = []

    class Stop(Exception):
        pass

    class Trees:
        def fit(self, rows):
            given.append((rows.rdd.getNumPartitions(), rows.count()))
            raise Stop

    monkeypatch.setattr(learn, "boosted_trees", lambda *a, **k: Trees())
    monkeypatch.setattr(learn, "HASHED_CELLS", 16 * 100, raising=False)
    df = spark.range(1000).selectExpr("double(id) AS a", "int(id % 2) AS target").coalesce(1)
    with pytest.raises(Stop):
        learn.HashedTrees(["a"], "target", width=16).fit(df)
    assert given == [(10, 1000)]


def test_hashed_trees_grow_on_the_places_that_differ(spark, monkeypatch):
    """No pass for each level of each tree over all hashed numbers; one table in one task or in several."""
    from tabspark.operators import boost

    table = separable(spark).withColumn("kind", F.when(F.col("target") == 1, "x")).drop("id", "split")
    probs = []
    for rows in (boost.RANGE_ROWS, 100):
        monkeypatch.setattr(boost, "RANGE_ROWS", rows)
        model = HashedTrees(["a", "b", "kind"], "target", width=64, maxIter=3).fit(table)
        scored = model.score(table.withColumn("prob", F.lit(9.0)))
        assert set(scored.columns) == {"a", "b", "kind", "target", "prob"}
        assert bool(model.model.trees.together) == (rows == 100) and len(model.model.places) == 3
        probs.append(scored.groupBy("target").agg(F.min("prob").alias("low"), F.max("prob").alias("high")).orderBy("target").collect())
    assert all(p[0]["high"] < 0.5 < p[1]["low"] for p in probs)


def test_hashed_trees_without_any_difference(spark):
    df = spark.range(50).select(F.lit(None).cast("string").alias("a"), (F.col("id") % 2).cast("int").alias("target"))
    assert [r["prob"] for r in HashedTrees(["a"], "target", width=8, maxIter=2).fit(df).score(df).select("prob").distinct().collect()] == [0.5]
