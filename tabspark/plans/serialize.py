"""Tables -> texts -> prompts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark import spec
from tabspark.functions import text
from tabspark.operators import clean

STYLES: dict[str, Callable[[Sequence[T.StructField]], Column]] = {
    "text_template": text.text_sentences,
    "json": text.text_json,
    "llm": text.text_record,
}


def serialize_table(
    df: DataFrame,
    dataset: spec.DatasetSpec,
    styles: Sequence[str] = tuple(spec.STYLE_COLUMNS),
    keep: Sequence[str] = ("split",),
    custom: Mapping[str, Callable[[Sequence[T.StructField]], Column]] | None = None,
) -> DataFrame:
    """Recode a table by its codebook and render every row; `keep` columns ride along and are not rendered.

    `custom` replaces the expression of a style: a function from the feature fields to a text column, which may be
    a pandas UDF. Unmapped targets raise.
    """
    keep = [c for c in keep if c in df.columns]
    table = clean.drop_if_present(df, *[c for c in dataset.drop if c not in keep])
    table = clean.recode_target(table, dataset.target, dataset.target_labels)
    table = clean.recode(table, dataset.categories)
    table = clean.recode_levels(table, dataset.levels)
    table = clean.recode_numbers(table, dataset.numeric)
    fields = [f for f in table.schema if f.name != "target_col" and f.name not in keep]
    makers = STYLES | dict(custom or {})
    # The order of the texts is fixed, whatever order was asked for.
    texts = [makers[s](fields).alias(c) for s, c in spec.STYLE_COLUMNS.items() if s in styles]
    return table.select(*keep, *texts, "target_col")


def with_prompt(df: DataFrame, dataset: spec.DatasetSpec, text_col: str = "text") -> DataFrame:
    return df.withColumn(
        "prompt", text.class_prompt(F.col(text_col), dataset.task, dataset.choices, dataset.positive)
    )
