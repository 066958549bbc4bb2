import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tabspark.operators import split as S


def hashed(key, seed=42):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest()


def keyed(spark, n, classes=3):
    return spark.range(n).select("id", (F.col("id") * 7 % 11 % classes).cast("int").alias("y"))


def shares(spark, sizes):
    table = spark.createDataFrame([(y, str(y), n) for y, n in sizes.items()], "stratum int, c string, n long")
    return {int(r["c"]): r["need"] for r in S.test_sizes(table, 0.2).collect()}


@pytest.mark.parametrize("n", [10, 286, 155, 25_000])
def test_stratified_split_equals_brute_force(spark, n):
    got = {r["id"]: (r["y"], r["split"]) for r in S.stratified_split(keyed(spark, n), "id", "y").collect()}
    by_class = {}
    for key, (y, _) in got.items():
        by_class.setdefault(y, []).append(key)
    sizes = shares(spark, {y: len(by_class[y]) for y in sorted(by_class)})
    assert sum(sizes.values()) == math.ceil(0.2 * n)
    for y, keys in by_class.items():
        test = set(sorted(keys, key=hashed)[: sizes[y]])
        assert {k for k in keys if got[k][1] == "test"} == test


def test_published_split_sizes(spark):
    assert sum(shares(spark, {0: 157, 1: 129}).values()) == 58
    assert shares(spark, {0: 157, 1: 129}) == {0: 32, 1: 26}
    assert shares(spark, {0: 123, 1: 32}) == {0: 25, 1: 6}


def test_deeper_search_levels_agree(spark, monkeypatch):
    """With tiny limits the search goes down digit by digit; the cuts stay the same."""
    df = keyed(spark, 5000)
    want = S.stratified_split(df, "id", "y").collect()
    monkeypatch.setattr(S, "PASSES", (1, 2, 3, 5, S.HASH_DIGITS))
    assert S.stratified_split(df, "id", "y").collect() == want
    monkeypatch.setattr(S, "LITERAL_CUTS", 0)
    assert sorted(S.stratified_split(df, "id", "y").collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("literal", [0, 1000])
def test_unbalanced_label(spark, monkeypatch, seed, literal):
    """One class in forty, with passes that meet both classes in every bucket."""
    monkeypatch.setattr(S, "PASSES", (1, 2, S.HASH_DIGITS))
    monkeypatch.setattr(S, "LITERAL_CUTS", literal)
    df = spark.range(4000).select("id", (F.col("id") % 41 == 0).cast("int").alias("y"))
    found = {(r["y"], r["split"]): r["count"] for r in S.stratified_split(df, "id", "y", seed=seed).groupBy("y", "split").count().collect()}
    assert found == {(0, "test"): 780, (0, "train"): 3122, (1, "test"): 20, (1, "train"): 78}


def test_many_classes(spark):
    df = spark.range(6000).select("id", (F.col("id") % 150).alias("y"))
    split = {(r["y"], r["split"]): r["count"] for r in S.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()}
    assert split == {(y, s): n for y in range(150) for s, n in (("test", 8), ("train", 32))}
    folds = S.stratified_folds(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    assert len(folds) == 750 and {r["count"] for r in folds} == {8}
    each = S.stratified_split(spark.range(500).withColumn("y", F.col("id")), "id", "y")
    assert each.where("split = 'test'").count() == 100


def test_split_does_not_depend_on_partitioning(spark):
    df = keyed(spark, 2000)
    a = {tuple(r) for r in S.stratified_split(df, "id", "y").collect()}
    assert a == {tuple(r) for r in S.stratified_split(df.repartition(37), "id", "y").collect()}


def test_copies_of_a_key_stay_together(spark):
    """A third of all rows share one key."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.lit(0).alias("y"))
    out = S.stratified_split(df, "k", "y")
    assert out.where("k = -1").select("split").distinct().count() == 1
    n_test = out.where("split = 'test'").count()
    assert n_test >= 1800 and n_test in (1800, *range(3000, 4801))


def test_null_class_is_a_class(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 != 0, 1).alias("y"))
    out = {(r["y"], r["split"]): r["count"] for r in S.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()}
    assert out == {(None, "test"): 5, (None, "train"): 20, (1, "test"): 15, (1, "train"): 60}


def test_group_split(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("g"), "id")
    out = S.group_split(df, "g")
    test = {r["g"] for r in out.where("split = 'test'").select("g").distinct().collect()}
    assert test == set(sorted(range(37), key=hashed)[: math.ceil(0.2 * 37)])
    assert S.split_overlap(out, "g").count() == 0
    S.require_disjoint(out, "g")
    with pytest.raises(ValueError):
        S.require_disjoint(out.withColumn("split", F.when(F.col("id") < 500, "train").otherwise("test")), "g")


@pytest.mark.parametrize("n, k", [(2989, 5), (124, 5), (7, 3), (4, 5)])
def test_folds(spark, n, k):
    df = keyed(spark, n, 2)
    found = S.stratified_folds(df, "id", "y", k).groupBy("y", "fold").count().collect()
    labels = sorted(r["y"] for r in df.collect())
    want = {}
    for i in range(k):
        for y in labels[i::k]:
            want[y, i] = want.get((y, i), 0) + 1
    assert {(r["y"], r["fold"]): r["count"] for r in found} == want


@pytest.mark.parametrize("rows", [7, 1000])
def test_many_classes_are_ordered_in_ranges(spark, monkeypatch, rows):
    """Classes of unlike size, one without a name: sizes of parts equal those counted one class after the other."""
    sizes = [(None if y == 5 else y, f"c{y}", 1 + y * y % 11) for y in range(60)]
    df = spark.createDataFrame(sizes, "stratum int, c string, n long")
    total, order = sum(n for *_, n in sizes), sorted(sizes, key=lambda x: (x[0] is not None, x[0] or 0))
    monkeypatch.setattr(S, "RANGE_ROWS", rows)
    want, offset = {}, 0
    for _, c, n in order:
        folds = [(offset + i) % 4 for i in range(n)]
        want |= {(c, k): sum(f <= k for f in folds) for k in range(3)}
        offset += n
    assert {(r["c"], r["part"]): r["need"] for r in S.fold_sizes(df, 4).collect()} == want
    wanted = math.ceil(0.3 * total)
    shares = {c: n / total * wanted for _, c, n in order}
    extra = sorted(order, key=lambda x: (math.floor(shares[x[1]]) - shares[x[1]], x[0] is not None, x[0] or 0))[: wanted - sum(map(math.floor, shares.values()))]
    want = {c: math.floor(shares[c]) + any(c == x[1] for x in extra) for _, c, _ in order}
    assert {r["c"]: r["need"] for r in S.test_sizes(df, 0.3).collect()} == want and sum(want.values()) == wanted


def test_rows_decide_for_themselves(spark):
    """The finished split has no shuffle, join or window."""
    plan = S.stratified_split(keyed(spark, 1000), "id", "y")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("rows, literal", [(10, 1000), (10, 0), (200_000, 1000)])
def test_cuts_are_the_same_in_one_pass_and_in_three(spark, monkeypatch, rows, literal):
    df = spark.range(500).select("id", (F.col("id") % 3).cast("int").alias("label")).withColumn("label", F.when(F.col("label") < 2, F.col("label")))
    want = {(r["id"], r["split"], r["fold"]) for r in S.stratified_folds(S.stratified_split(df, "id", "label"), "id", "label").collect()}
    monkeypatch.setattr(S, "RANGE_ROWS", rows)
    monkeypatch.setattr(S, "LITERAL_CUTS", literal)
    got = {(r["id"], r["split"], r["fold"]) for r in S.stratified_folds(S.stratified_split(df, "id", "label"), "id", "label").collect()}
    assert got == want and sum(s == "test" for _, s, _ in got) == 100
