"""Row-to-text expressions: Python-style number text, JSON, sentences, prompts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark import spec


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Shortest digits that give the same double, the nearest of them. The JVM's own text of a double may differ from them.
DIGITS = ("com.fasterxml.jackson.core.io.schubfach.DoubleToDecimal", "toString")


def py_float_str(col: Column) -> Column:
    """Text of a double as Python prints it: shortest digits, exponent only below 1e-4 or from 1e16. NaN gives null."""

    def shown(text: Column) -> Column:
        # As Java writes it: plain between 1e-3 and 1e7, else one digit, the others and an exponent.
        size = F.regexp_replace(F.substring_index(text, "E", 1), "^-", "")
        digits = F.regexp_replace(F.replace(size, F.lit("."), F.lit("")), "(?<=.)0+$", "")
        exponent = F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int"))
        whole = F.rpad(digits, exponent + 1, F.lit("0"))
        large = F.concat(
            F.substr(whole, F.lit(1), exponent + 1), F.lit("."),
            F.when(F.length(digits) > exponent + 1, F.substr(digits, exponent + 2)).otherwise("0"),
        )
        power = F.abs(exponent).cast("string")
        scientific = F.concat(
            F.regexp_replace(size, r"\.0$", ""), F.when(exponent < 0, "e-").otherwise("e+"),
            F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power),
        )
        number = (
            F.when(exponent.isNull(), size)
            .when((exponent >= 16) | (exponent < -4), scientific)
            .when(exponent == -4, F.concat(F.lit("0.000"), digits))
            .otherwise(large)
        )
        return F.concat(F.when(text.startswith("-"), "-").otherwise(""), number)

    text = F.reflect(*[F.lit(x) for x in DIGITS], F.coalesce(col, F.lit(0.0)))
    # As a lambda variable the text is made once, however often the expression uses it.
    made = F.element_at(F.transform(F.array(text), shown), 1)
    infinite = F.when(col > 0, "inf").otherwise("-inf")
    return F.when(col.isNull() | F.isnan(col), None).when(F.abs(col) == float("inf"), infinite).otherwise(made)


# The named escapes of JSON text; the backslash comes first.
NAMED_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(col: Column) -> Column:
    """Quoted JSON text, ASCII only."""
    escaped = col
    for raw, text in NAMED_ESCAPES.items():
        escaped = F.replace(escaped, F.lit(raw), F.lit(text))
    ascii_only = F.when(col.rlike(r"[^ -~]"), _unicode_escapes(escaped)).otherwise(escaped)
    return F.concat(F.lit('"'), ascii_only, F.lit('"'))


def _unicode_escapes(col: Column) -> Column:
    """Every character outside printable ASCII as UTF-16 code units; each character is looked at once."""

    def escape(ch: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when((ch >= " ") & (ch <= "~"), ch).otherwise(units)

    return F.array_join(F.transform(F.split(col, ""), escape), "")


def text_value(field: T.StructField) -> Column:
    """Cell as Python would print it; missing -> null."""
    col = quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return py_float_str(col.cast("double"))
    if isinstance(field.dataType, T.BooleanType):
        return F.initcap(col.cast("string"))
    return col.cast("string")


def json_value(field: T.StructField) -> Column:
    col = quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.replace(py_float_str(col.cast("double")), F.lit("inf"), F.lit("Infinity"))
    if isinstance(field.dataType, (T.BooleanType, T.IntegralType)):
        return col.cast("string")
    return json_string(col.cast("string"))


def text_sentences(fields: Sequence[T.StructField]) -> Column:
    """'The c is v.' for every column, joined by a blank."""
    lead, middle, end = spec.SENTENCE
    return F.concat_ws(
        " ",
        *[
            F.concat(F.lit(f"{lead}{f.name}{middle}"), F.coalesce(text_value(f), F.lit(spec.UNKNOWN)), F.lit(end))
            for f in fields
        ],
    )


def text_json(fields: Sequence[T.StructField]) -> Column:
    """One-line JSON object in column order."""
    unknown = json.dumps(spec.UNKNOWN)
    pairs = [
        F.concat(F.lit(json.dumps(f.name) + ": "), F.coalesce(json_value(f), F.lit(unknown))) for f in fields
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def text_record(fields: Sequence[T.StructField], lead: str = spec.RECORD_LEAD) -> Column:
    """One sentence naming every column and value."""
    phrases = [F.concat(F.lit(f.name + " "), F.coalesce(text_value(f), F.lit(spec.UNKNOWN))) for f in fields]
    return F.concat(F.lit(lead), F.concat_ws(", ", *phrases), F.lit("."))


def rewrite_prompt(fields: Sequence[T.StructField]) -> Column:
    """Prompt asking a model to put one row into a sentence."""
    return F.concat(F.lit(spec.REWRITE_HEAD), text_json(fields), F.lit(spec.REWRITE_TAIL))


def class_prompt(text: Column, task: str, labels: Sequence[str], positive: str) -> Column:
    """Classification prompt around a rendered row."""
    negative = spec.negative_of(list(labels), positive)
    tail = spec.PROMPT_TAIL.format(
        task=task,
        positive=spec.ANSWER_LABELS[1],
        negative=spec.ANSWER_LABELS[0],
        positive_target=positive,
        negative_target=negative,
    )
    return F.concat(F.lit(spec.PROMPT_HEAD), text, F.lit(tail))
