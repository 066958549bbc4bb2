from pyspark.sql import functions as F

from tabspark import staging


def test_written_tables_go_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    out = staging.staged(spark.range(10).select("id", (F.col("id") % 2).alias("part")), partition_by="part")
    assert out.count() == 10 and all(named in f for f in out.inputFiles())
    staging.ensure_checkpoint_dir(spark)
    assert named in spark.sparkContext.getCheckpointDir()


def test_only_counted_tables_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(staging, "SMALL_ROWS", 5)
    big = spark.range(100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for n, broadcast in ((5, True), (6, False)):
            joined = big.join(staging.small(spark.range(n).selectExpr("id", "id * 2 AS twice")), "id", "left")
            assert ("Broadcast" in joined._jdf.queryExecution().executedPlan().toString()) == broadcast
            assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
