"""Seeded, exact, leak-free splits.

Every unit (row key or group) gets the md5 text of 'key:seed'. A split is a cut of that hash order, so once the cut
hash of a class is known each row decides for itself: no row is moved, ranked or sorted. Cuts are found by counting:
units per class and leading hash digits, then only inside the digits that hold a cut, until the hash itself is known. Units
that fit one task (RANGE_ROWS) are counted by whole hashes at once.
Classes, counts and cuts stay tables, so their number has no limit. Copies of a key share a hash and stay on one side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.functions.text import quoted
from tabspark.staging import RANGE_ROWS, in_ranges, staged

HASH_DIGITS = 32
#: Leading hash digits of the counting passes: the last one counts whole hashes.
PASSES = (3, 6, HASH_DIGITS)
#: Cuts that are written into the plan as literals; more of them are joined by class.
LITERAL_CUTS = 1000


def unit_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))


def class_key(label: Column) -> Column:
    """Text of a class; missing labels are a class of their own."""
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))


def _units(label: Column, key: Column, seed: int) -> list[Column]:
    return [label.alias("stratum"), class_key(label).alias("c"), unit_hash(key, seed).alias("h")]


def _class_sizes(units: DataFrame) -> DataFrame:
    """(stratum, c, n): one row per class."""
    return staged(units.groupBy("stratum", "c").agg(F.count("*").alias("n")))


def _find_cuts(units: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """units (c, h), `rows` in number; wanted (c, part, need); gives (c, part, cut).

    A cut is the smallest hash such that at least `need` units of the class have a hash up to it. A pass counts whole hashes as
    soon as the units that share the digits of a cut are few enough for one task: for small tables the first pass does.
    """
    found = wanted.where("need > 0").select("c", "part", "need", F.lit("").alias("prefix"))
    known, few = 0, []
    for planned in PASSES:
        digits = planned if rows > RANGE_ROWS else HASH_DIGITS
        inside = units.withColumn("prefix", F.substring("h", 1, known))
        if known:
            # A few classes and parts: the filter is a list in the plan. Else both sides meet by class and digits.
            if len(few) <= LITERAL_CUTS:
                inside = inside.where(F.concat("prefix", "c").isin([r["prefix"] + r["c"] for r in few]))
            else:
                inside = inside.join(found.select("c", "prefix").distinct(), ["c", "prefix"], "left_semi")
        counted = inside.groupBy("c", "prefix", F.substring("h", 1, digits).alias("longer")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy("c", "prefix").orderBy("longer").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("upto", F.sum("n").over(upto))
        reached = found.drop("n").join(counted, ["c", "prefix"]).where("upto >= need")
        first = F.min(F.struct("longer", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n")).alias("x")
        found = staged(reached.groupBy("c", "part").agg(first).select("c", "part", "x.need", F.col("x.longer").alias("prefix"), "x.n"))
        known = digits
        if known == HASH_DIGITS:
            break
        held = found.select("c", "prefix", "n").distinct()
        few = held.limit(LITERAL_CUTS + 1).collect()
        rows = sum(r["n"] for r in few) if len(few) <= LITERAL_CUTS else held.agg(F.sum("n")).first()[0]
    return found.select("c", "part", F.col("prefix").alias("cut"))


def _many(sizes: DataFrame) -> int:
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _sum_before(df: DataFrame, value: Column, *order: Column) -> DataFrame:
    """All columns, and `offset`: the sum over the rows before in the order. No task orders more than RANGE_ROWS rows."""
    if df.count() <= RANGE_ROWS:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("offset", F.coalesce(F.sum(value).over(before), F.lit(0)))
    ranged = in_ranges(df, *order, rows=RANGE_ROWS)
    inside = Window.partitionBy("__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range goes through this window.
    ranges = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    lower = ranged.groupBy("__r").agg(F.sum(value).alias("__n")).select("__r", F.coalesce(F.sum("__n").over(ranges), F.lit(0)).alias("__lower"))
    placed = ranged.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(lower, "__r")
    return placed.select(*df.columns, (F.col("__lower") + F.col("__inside")).alias("offset"))


def test_sizes(sizes: DataFrame, frac: float, total: int | None = None) -> DataFrame:
    """(c, part, need): units per class in the test part, ceil(frac * n) in all, shared out by largest remainder."""
    total = _many(sizes) if total is None else total
    wanted = math.ceil(frac * total)
    exact = sizes.withColumn("exact", F.try_divide(F.col("n").cast("double"), F.lit(total)) * wanted)
    exact = exact.withColumn("base", F.floor("exact"))
    rest = wanted - (exact.agg(F.sum("base")).first()[0] or 0)
    placed = _sum_before(exact, F.lit(1), F.col("base") - F.col("exact"), F.asc_nulls_first("stratum"))
    return placed.select("c", F.lit(0).alias("part"), (F.col("base") + (F.col("offset") < rest).cast("int")).alias("need"))


def fold_sizes(sizes: DataFrame, k: int) -> DataFrame:
    """(c, part, need): units per class up to each fold but the last; classes are laid end to end in order and dealt out in turn."""
    placed = _sum_before(sizes, F.col("n"), F.asc_nulls_first("stratum"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("part")
    dealt = placed.select("c", "n", "offset", fold).withColumn("skip", F.pmod(F.col("part") - F.col("offset"), F.lit(k)))
    own = F.greatest(F.floor((F.col("n") - F.col("skip") + (k - 1)) / k), F.lit(0))
    upto = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.select("c", "part", F.sum(own).over(upto).alias("need")).where(F.col("part") < k - 1)


def _count_passed(df: DataFrame, label: Column, h: Column, cuts: DataFrame, name: str, include: bool) -> DataFrame:
    """Add how many of the cuts of its class a row lies above, or, with include, up to how many it lies."""
    listed = cuts.groupBy("c").agg(F.collect_list("cut").alias("cuts"))
    few = cuts.limit(LITERAL_CUTS + 1).collect()
    c = class_key(label)
    if len(few) <= LITERAL_CUTS:
        by_class: dict = {}
        for r in few:
            by_class.setdefault(r["c"], []).append(r["cut"])
        number = F.lit(0)
        for key, bounds in by_class.items():
            counted = F.lit(0)
            for cut in sorted(bounds):
                counted = counted + ((h <= cut) if include else (h > cut)).cast("int")
            number = F.when(c == F.lit(key), counted).otherwise(number)
        return df.withColumn(name, number)
    beyond = F.size(F.filter("__cuts", lambda cut: (h <= cut) if include else (h > cut)))
    listed = listed.select(F.col("c").alias("__c"), F.col("cuts").alias("__cuts"))
    joined = df.join(listed, c == F.col("__c"), "left").withColumn(name, F.when(F.col("__cuts").isNull(), 0).otherwise(beyond))
    return joined.drop("__c", "__cuts")


def stratified_split(
    df: DataFrame, key: str, label: str, frac: float = spec.TEST_FRACTION, seed: int = spec.SEED
) -> DataFrame:
    """Add `split` ('train' / 'test'); class shares are kept, the test part has ceil(frac * n) rows for unique keys.

    Action: reads the key and label columns a few times to find one cut hash per class.
    """
    units = df.select(*_units(quoted(label), quoted(key), seed))
    sizes = _class_sizes(units)
    total = _many(sizes)
    cuts = _find_cuts(units, test_sizes(sizes, frac, total), total)
    marked = _count_passed(df, quoted(label), unit_hash(quoted(key), seed), cuts, "split", include=True)
    return marked.withColumn("split", F.when(F.col("split") > 0, "test").otherwise("train"))


def group_split(df: DataFrame, group: str, frac: float = spec.TEST_FRACTION, seed: int = spec.SEED) -> DataFrame:
    """Add `split` so that all rows of a group are on one side; ceil(frac * groups) groups are in the test part."""
    # The groups are written once: counting them must not run the whole input again.
    groups = df.select(quoted(group).alias("g")).distinct()
    units = staged(groups.select(*_units(F.lit(0), F.col("g"), seed)))
    sizes = _class_sizes(units)
    total = _many(sizes)
    cuts = _find_cuts(units, test_sizes(sizes, frac, total), total)
    marked = _count_passed(df, F.lit(0), unit_hash(quoted(group), seed), cuts, "split", include=True)
    return marked.withColumn("split", F.when(F.col("split") > 0, "test").otherwise("train"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = spec.CV_FOLDS, seed: int = spec.SEED) -> DataFrame:
    """Add `fold` (0..k-1) with class shares kept in every fold."""
    units = df.select(*_units(quoted(label), quoted(key), seed))
    sizes = _class_sizes(units)
    needs = staged(fold_sizes(sizes, k))
    cuts = _find_cuts(units, needs, _many(sizes))
    # Parts that end before the first unit have no cut: every row lies above them.
    empty = needs.where("need <= 0").select("c", "part", F.lit("").alias("cut"))
    return _count_passed(df, quoted(label), unit_hash(quoted(key), seed), cuts.union(empty), "fold", include=False)


def split_overlap(df: DataFrame, key: str) -> DataFrame:
    """Groups found in more than one split (none for a leak-free split)."""
    return (
        df.groupBy(key)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .where(F.col("first_split") != F.col("last_split"))
    )


def require_disjoint(df: DataFrame, key: str) -> None:
    """Action: raise when a group is in both splits."""
    shared = split_overlap(df, key).limit(1).collect()
    if shared:
        raise ValueError(f"{key} {shared[0][key]!r} is in both splits")
