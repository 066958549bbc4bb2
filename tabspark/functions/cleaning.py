"""Cleaning expressions: sentinels, numeric conversion, time, recoding, label rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabspark.spec import ANSWER_LABELS, MISSING_MARK, POSITIVE_THRESHOLD, UNKNOWN

# try_cast alone would accept forms such as '1d', which the coercion rule rejects.
NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def null_if(col: Column, *sentinels) -> Column:
    """Exact-match sentinels become null."""
    return F.when(col.isin(*sentinels), None).otherwise(col)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def to_numeric(col: Column) -> Column:
    """Double; whatever is not a number becomes null."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_numeric_strict(col: Column) -> Column:
    """Double; null stays null, anything else that is not a number fails the query."""
    number = to_numeric(col)
    text = col.cast("string")
    failed = F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")
    return F.when(text.isNull() | (F.lower(text) == "nan"), None).when(number.isNull(), failed).otherwise(number)


def to_int_code(col: Column) -> Column:
    """Integer code, truncated toward zero; not a number -> null."""
    return to_numeric(col).try_cast("int")


def parse_ts(date: Column, time: Column, fmt: str = "M-d-yyyy H:m") -> Column:
    """Timestamp of a date text and a time text; impossible dates become null."""
    return F.try_to_timestamp(F.concat(date, F.lit(" "), time), F.lit(fmt))


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])


def lookup(col: Column, mapping: Mapping, default=None) -> Column:
    """Value of the map for this key, else the default."""
    found = F.try_element_at(literal_map(mapping), col) if mapping else F.lit(None).cast("string")
    return found if default is None else F.coalesce(found, F.lit(default))


def category_key(col: Column) -> Column:
    """Integer text of a category code ('1.0' -> '1'); missing -> null."""
    return to_numeric_strict(null_if(col.cast("string"), MISSING_MARK)).cast("bigint").cast("string")


def category_label(col: Column, mapping: Mapping[str, str]) -> Column:
    return lookup(category_key(col), mapping, UNKNOWN)


def numeric_value(col: Column) -> Column:
    return to_numeric_strict(null_if(col.cast("string"), MISSING_MARK))


def nearest_level(col: Column, levels: Mapping[str, str]) -> Column:
    """Label of the nearest prototype; ties go to the one listed first."""
    value = numeric_value(col)
    candidates = [
        F.struct(F.abs(value - F.lit(float(k))).alias("gap"), F.lit(i).alias("ord"), F.lit(label).alias("label"))
        for i, (k, label) in enumerate(levels.items())
    ]
    return F.when(value.isNull(), UNKNOWN).otherwise(F.array_min(F.array(*candidates))["label"])


def binarize(col: Column, above: float | None = None, mapping: Mapping[int, int] | None = None) -> Column:
    """0/1 target by a bound (strictly above) or by an explicit code map."""
    if (above is None) == (mapping is None):
        raise ValueError("give either a bound or a mapping")
    return (col > above).cast("int") if mapping is None else lookup(col, mapping)


def expected_answer(col: Column, positive: str, negative: str) -> Column:
    """Answer word a perfect reply would contain; other target labels -> null."""
    return lookup(col, {positive: ANSWER_LABELS[1], negative: ANSWER_LABELS[0]})


def is_correct(truth: Column, pred: Column) -> Column:
    return truth == pred


def threshold(prob: Column, t: float = POSITIVE_THRESHOLD) -> Column:
    return (prob >= t).cast("int")


def positive_prob(probs: Column, classes: Sequence[int]) -> Column:
    """Probability of class 1 out of a two-element array in class order."""
    classes = list(classes)
    if len(classes) != 2:
        raise ValueError(f"probabilities for two classes are required, got {classes}")
    if classes.count(1) != 1:
        raise ValueError(f"a unique positive class 1 is required, got {classes}")
    wrong = F.raise_error(F.lit("probabilities for two classes are required")).cast("double")
    return F.when(F.size(probs) != 2, wrong).otherwise(F.element_at(probs, classes.index(1) + 1).cast("double"))
