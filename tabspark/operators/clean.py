"""Row-level cleaning of event logs and attribute tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.functions import cleaning as C
from tabspark.functions.text import quoted
from tabspark.staging import small

SHOWN_VALUES = 100


def clean_events(df: DataFrame, codes: Iterable[int] = tuple(spec.EVENT_CODES)) -> DataFrame:
    """Raw log rows (date, time, code, value, ...) -> known codes, valid timestamps, numeric or missing value."""
    return (
        df.withColumn("code", C.to_int_code(F.col("code")))
        .where(F.col("code").isin(*codes))
        .withColumn("datetime", C.parse_ts(F.col("date"), F.col("time")))
        .where(F.col("datetime").isNotNull())
        .drop("date", "time")
        .withColumn("value", C.to_numeric(F.col("value")))
    )


def name_events(df: DataFrame, names: Mapping[int, str] = spec.EVENT_CODES, code: str = "code") -> DataFrame:
    """Add `event`, the name of the event code."""
    return df.withColumn("event", C.lookup(quoted(code).cast("string"), {str(k): v for k, v in names.items()}))


def keep_known(df: DataFrame, col: str, known: Iterable) -> DataFrame:
    """Rows whose value is in the domain."""
    return df.where(quoted(col).isin(*known))


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def as_target(df: DataFrame, col: str, name: str = "target") -> DataFrame:
    return df.withColumnRenamed(col, name)


def recode(df: DataFrame, categories: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Category codes -> codebook labels, unknown or missing codes -> 'unknown'."""
    return df.withColumns({c: C.category_label(quoted(c), m) for c, m in categories.items()})


def recode_levels(df: DataFrame, levels: Mapping[str, Mapping[str, str]]) -> DataFrame:
    return df.withColumns({c: C.nearest_level(quoted(c), m) for c, m in levels.items()})


def recode_numbers(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({c: C.numeric_value(quoted(c)) for c in names})


def join_codebook(df: DataFrame, codebook: DataFrame, code: Column, dataset: str, column: str) -> DataFrame:
    """Add `label` and `ord` from a codebook table (dataset, column, kind, code, label, ord)."""
    side = codebook.where((F.col("dataset") == dataset) & (F.col("column") == column)).select(
        F.col("code").alias("__code"), "label", "ord"
    )
    joined = df.withColumn("__code", code.cast("string")).join(small(side), "__code", "left").drop("__code")
    return joined.withColumn("label", F.coalesce("label", F.lit(spec.UNKNOWN)))


def unmapped(df: DataFrame, col: str, mapping: Mapping[str, str], key: Column | None = None) -> DataFrame:
    """Distinct raw values the mapping has no label for (one column `value`, text)."""
    key = C.category_key(quoted(col)) if key is None else key
    return df.where(C.lookup(key, mapping).isNull()).select(quoted(col).cast("string").alias("value")).distinct()


def require_mapped(df: DataFrame, col: str, mapping: Mapping[str, str], key: Column | None = None) -> None:
    """Action: raise with the sorted distinct values that have no label."""
    bad = unmapped(df, col, mapping, key)
    first = [row["value"] for row in bad.orderBy("value").limit(SHOWN_VALUES + 1).collect()]
    if first:
        more = "" if len(first) <= SHOWN_VALUES else f" and more ({bad.count()} in all)"
        shown = ["nan" if v is None else v for v in first[:SHOWN_VALUES]]
        raise ValueError(f"unmapped values in column {col!r}: {sorted(shown)}{more}")


def recode_target(df: DataFrame, col: str, mapping: Mapping[str, str], name: str = "target_col") -> DataFrame:
    """Target code -> target label under the common name; unmapped values raise."""
    require_mapped(df, col, mapping)
    return df.withColumn(col, C.lookup(C.category_key(quoted(col)), mapping)).withColumnRenamed(col, name)
