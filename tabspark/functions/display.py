"""Result labels and cell texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabspark import spec
from tabspark.functions.cleaning import lookup


def run_keys(path: Column, root: str) -> dict[str, Column]:
    """dataset, serialization and model of an answer file below the results root."""
    # File sources report percent-encoded URIs.
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    parts = F.split(F.substring_index(plain, root.rstrip("/") + "/", -1), "/")
    # A file of answers may also be a folder of part files, as Spark writes it.
    return {
        "dataset": F.element_at(parts, 1),
        "serialization": F.try_element_at(parts, F.lit(2)),
        "model": F.replace(F.try_element_at(parts, F.lit(3)), F.lit("_raw_responses.csv"), F.lit("")),
    }


def title_case(col: Column) -> Column:
    return F.initcap(F.translate(col, "_", " "))


def model_label(source: Column, model: Column, style: Column, approach: Column) -> Column:
    """Readable, unique name of an evaluated configuration."""
    answers = F.concat(
        F.lit(f"{spec.ANSWER_PREFIX}: "), F.coalesce(model, F.lit("unknown")), F.lit(" ["),
        F.coalesce(style, F.lit("unknown")), F.lit("]"),
    )
    return (
        F.when(source == spec.ANSWER_SOURCE, answers)
        .when((source == spec.ENCODER_SOURCE) & approach.isNotNull(), F.concat(F.lit(f"{spec.ENCODER_PREFIX}: "), approach))
        .otherwise(F.coalesce(lookup(source, spec.DISPLAY_NAMES), title_case(source)))
    )


def total_time(a: Column, b: Column) -> Column:
    """Sum that is missing as soon as one part is."""
    return a + b


def _formatted(value: Column, pattern: str) -> Column:
    """Python's format of a double, a batch at a time: rounded on its exact binary value, ties to even. Missing stays null."""

    @pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else format(float(x), pattern) for x in values], dtype=object)

    return shown(value.cast("double"))


def fixed_text(value: Column, places: int) -> Column:
    """Fixed number of decimals."""
    return _formatted(value, f".{places}f")


def significant_text(value: Column) -> Column:
    """Three significant digits, Python's general format."""
    return _formatted(value, ".3g")


def cell_text(value: Column, kind: str) -> Column:
    """Display text: kind 'metric' has three decimals, kind 'time' three significant digits and a unit."""
    value = F.when(~F.isnan(value), value)
    if kind == "metric":
        return F.coalesce(fixed_text(value, 3), F.lit("-"))
    if kind == "time":
        return F.when(value.isNull(), "-").when(value <= 0, "0 s").otherwise(F.concat(significant_text(value), F.lit(" s")))
    raise ValueError(f"unknown kind {kind!r}")


def percent_text(share: Column) -> Column:
    """Share as a percentage with one decimal."""
    return F.concat(fixed_text(share * 100, 1), F.lit("%"))
