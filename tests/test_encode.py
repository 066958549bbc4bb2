"""The frozen encoder against a singular value decomposition of all rows at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.operators.encode import EncodedTrees, RowEncoder
from tabspark.plans.benchmark import evaluate


def rows(spark, n=300):
    out = spark.range(n).select(
        "id",
        F.expr("CASE WHEN id % 23 < 11 THEN 's0' WHEN id % 23 < 18 THEN 's1' WHEN id % 23 < 22 THEN 's2' ELSE 's3' END").alias("s"),
        (F.col("id") % 7 - 3).cast("double").alias("a"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 11).cast("double") * 1000).alias("b"),
    )
    return out.withColumn("target", (F.col("s").isin("s1", "s2") & (F.col("a") > -2)).cast("int")).repartition(5)


def test_projections_equal_a_decomposition_of_all_rows(spark):
    df = rows(spark)
    encoder = RowEncoder(["s", "a", "b"], size=3, width=32).fit(df)
    hashed = encoder.hashed(df).select("id", "hashed").toPandas().sort_values("id")
    x = np.stack(hashed["hashed"])
    _, strength, right = np.linalg.svd(x, full_matrices=False)
    got = encoder.transform(df).toPandas().sort_values("id")[encoder.names].to_numpy()
    assert got.shape == (300, 3) and np.all(np.diff(strength[:4]) < -1e-6)
    assert np.allclose(np.abs(got), np.abs(x @ right[:3].T), atol=1e-8)
    assert np.allclose((got**2).sum(axis=0), strength[:3] ** 2)


def test_rows_to_encode_change_nothing(spark):
    df = rows(spark)
    train, test = df.where("id < 200"), df.where("id >= 200")
    encoder = RowEncoder(["s", "a", "b"], size=4, width=32).fit(train)
    before = encoder.directions.copy()
    strange = test.withColumn("s", F.lit("never seen")).withColumn("a", F.lit(1e9))
    assert encoder.transform(strange.unionByName(test)).count() == 200
    assert np.array_equal(encoder.directions, before)
    again = RowEncoder(["s", "a", "b"], size=4, width=32).fit(train.repartition(2))
    assert np.allclose(again.directions, before, atol=1e-8)


def test_edge_cases(spark):
    df = rows(spark, 20)
    with pytest.raises(RuntimeError):
        _ = RowEncoder(["a"]).names
    empty = RowEncoder(["a"], width=8).fit(df.where("false"))
    assert empty.names == [] and empty.transform(df).columns == df.columns
    none = df.select("id", F.lit(None).cast("double").alias("a"), F.col("s").alias("encoded_9"))
    out = RowEncoder(["a", "encoded_9"], size=2, width=8).fit(none).transform(none)
    assert out.count() == 20 and out.columns[:3] == none.columns


def test_trees_over_the_encoder(spark):
    df = rows(spark).withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    out = evaluate(df, EncodedTrees(["s", "a", "b"], "target", size=6, width=64, maxIter=30, stepSize=0.3)).first()
    assert out["test_f1_macro"] > 0.9 and out["test_auc"] > 0.95
    with pytest.raises(RuntimeError):
        EncodedTrees(["a"], "target").score(df)
