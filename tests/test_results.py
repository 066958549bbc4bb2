import pytest
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.operators import responses, results
from tabspark.plans.answers import CARRIED, rebuild_results
from tabspark.plans.benchmark import compare_results, label_results
from tabspark.sources.readers import read_results

RUN = "dataset string, model string, serialization string, f double"


def test_upsert_is_idempotent(spark, rows):
    base = spark.createDataFrame([("d", "m", "json", 1.0), ("d", "m", "llm", 2.0)], RUN)
    new = spark.createDataFrame([("d", "m", "json", 9.0), ("e", "m", "json", 3.0)], RUN)
    once = results.upsert(base, new)
    want = [("d", "m", "json", 9.0), ("d", "m", "llm", 2.0), ("e", "m", "json", 3.0)]
    assert rows(once, "dataset", "serialization") == want
    assert rows(results.upsert(once, new), "dataset", "serialization") == want


def test_rebuilt_results_keep_old_timings(spark):
    answers = spark.createDataFrame(
        [("heart", "m", "json", "heart disease", "positive"), ("heart", "new", "json", "heart disease", "negative")],
        "dataset string, model string, serialization string, target_col string, output string",
    )
    old = spark.createDataFrame(
        [("heart", "m", "json", 1.5, 58, 1, 0), ("heart", "m", "json", 2.5, 58, 4, 1)],
        "dataset string, model string, serialization string, prediction_time_seconds double, total_examples int, batch_size int, at int",
    )
    out = {r["model"]: r for r in rebuild_results(answers, old, spec.DATASETS, "at").collect()}
    assert (out["m"]["prediction_time_seconds"], out["m"]["batch_size"], out["m"]["train_time_seconds"]) == (2.5, 4, 0.0)
    assert out["new"]["prediction_time_seconds"] is None
    assert set(CARRIED) <= set(rebuild_results(answers, None, spec.DATASETS).columns)


def test_merge_and_rank(spark, tmp_path):
    def put(source, text):
        (tmp_path / source).mkdir()
        (tmp_path / source / f"{source}_results.csv").write_text(text)

    put("xgboost", "dataset,test_f1_macro,train_time_seconds,prediction_time_seconds\nheart,0.8,1,0.5\nheart,0.6,3,0.5\n")
    put("tarte", "dataset,approach,test_f1_macro,train_time_seconds,prediction_time_seconds\nheart,enc,0.7,0.1,0.1\n")
    put("tabllm", "dataset,model,serialization,test_f1_macro,train_time_seconds,prediction_time_seconds\nheart,m,json,bad,0,\n")
    put("notes", "name,value\na,1\n")
    merged = label_results(read_results(spark, str(tmp_path)))
    out = [(r["quality_rank"], r["runtime_rank"], r["model_label"], r["test_f1_macro"]) for r in compare_results(merged).orderBy("quality_rank").collect()]
    assert out == [(1, 1, "TARTE: enc", 0.7), (2, 2, "XGBoost", pytest.approx(0.7)), (3, 3, "TabLLM: m [json]", None)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "sub" / "x").mkdir(parents=True)
        (tmp_path / "sub" / "x" / "x_results.csv").write_text("name\n1\n")
        read_results(spark, str(tmp_path / "sub"))


def test_grid(spark):
    assert results.run_grid(spark, ["a", "b"], ["x", "y", "z"], ["s", "t", "u"]).count() == 18
    assert results.run_grid(spark, ["a"], [], ["s"]).count() == 0


def test_best_configuration_ties_go_to_the_first(spark):
    scores = spark.createDataFrame([(c, f, x) for c, x in ((2, 0.5), (0, 0.5), (1, 0.4)) for f in range(2)], "config int, fold int, f1_macro double")
    assert results.best_config(scores, "config").first()["config"] == 0


def test_times(spark):
    df = spark.createDataFrame(
        [("d", "a", "j", 0.0, 4.0), ("d", "a", "t", 0.0, 9.0), ("d", "a", "u", 0.0, None), ("e", "a", "j", 0.0, 2.0), ("f", "a", "j", 0.0, 0.0)],
        "dataset string, model string, serialization string, train_time_seconds double, prediction_time_seconds double",
    )
    spread = {r["dataset"]: (r["spread"], r["fastest"], r["slowest"]) for r in results.time_spread(df, ["dataset"], "serialization").collect()}
    assert spread["d"] == (5.0, "j", "t")
    ranges = {r["dataset"]: (r["time_min"], r["time_max"]) for r in results.time_range(df).collect()}
    assert ranges == {"d": (4.0, 9.0), "e": (0.2, 20.0), "f": (None, None)}


def test_pattern_ranking_limits_before_the_shuffle(spark):
    """A third of the rows belong to one run with all-distinct answers: only the top rows leave each task."""
    df = spark.range(6000).select((F.col("id") % 3).alias("run"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1).cast("string").alias("output"))
    out = responses.answer_patterns(df, ["run"], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert {(r["run"], r["rank"], r["n"]) for r in out.collect()} == {(0, 1, 1), (0, 2, 1), (1, 1, 2000), (2, 1, 2000)}


def test_pattern_ranking_in_slices(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 3).alias("run"), (F.col("id") * 7 % 1301).cast("string").alias("output"))
    want = {tuple(r) for r in responses.answer_patterns(df, ["run"], 40).collect()}
    monkeypatch.setattr(responses, "SLICES", 3)
    assert {tuple(r) for r in responses.answer_patterns(df, ["run"], 40).collect()} == want and len(want) == 120


def test_missing_means_come_last(spark):
    rows = [(0, None), (0, None), (1, 0.2), (1, 0.4), (2, float("nan"))]
    scores = spark.createDataFrame(rows, "config int, f1_macro double")
    assert results.best_config(scores, "config").first()["config"] == 1


def test_carried_values_come_from_one_row(spark):
    new = spark.createDataFrame([("a", "m", "s", 1.0)], "dataset string, model string, serialization string, x double")
    old = spark.createDataFrame([("a", "m", "s", 5.0), ("a", "m", "s", 6.0)], "dataset string, model string, serialization string, t double")
    assert [r["t"] for r in results.carry_over(new, old.coalesce(1), ["t"]).collect()] == [6.0]


def test_dataset_list(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "dataset string")
    assert [r[0] for r in results.dataset_list(df).collect()] == ["a", "b"]
