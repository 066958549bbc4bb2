"""Reading labels out of free-text answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabspark.spec import INVALID_LABEL

BEGIN, INSIDE = "<", "="  # no normalized text holds these
SPAN = "array<struct<start:int,end:int,label:string>>"


def normalize_text(col: Column) -> Column:
    """Lower case, every run outside a-z0-9 becomes one blank, ends trimmed; missing -> ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " "))


def label_words(label: str) -> list[str]:
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in label.lower()).split()
    if not words:
        raise ValueError(f"label {label!r} has no letters or digits")
    return words


def _inside(short: list[str], long: list[str]) -> bool:
    return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


def _marked(text: Column, label: str) -> Column:
    """The characters of the normalized text, those of whole-word matches of the label replaced by BEGIN and INSIDE; [] without any."""
    phrase = " ".join(label_words(label))
    marks = F.regexp_replace(text, f"(?<![a-z0-9]){phrase}(?![a-z0-9])", BEGIN + INSIDE * (len(phrase) - 1))
    return F.when(text.contains(phrase), F.split(marks, "")).otherwise(F.array().cast("array<string>"))


def _spans(marked: Column, label: str, around: list[Column]) -> Column:
    """The label's matches as character spans, without those that lie inside a match of another label (by its marked text)."""
    length = len(" ".join(label_words(label)))

    def covered(at: Column, other: Column) -> Column:
        # Two matches never touch: between them stands at least a blank. So marks without a gap are one match.
        part = F.slice(other, at + 1, F.lit(length))
        return (F.size(part) == length) & F.forall(part, lambda x: x.isin(BEGIN, INSIDE))

    at = F.filter(F.sequence(F.lit(0), F.size(marked)), lambda i: F.get(marked, i) == BEGIN)
    if around:
        at = F.filter(at, lambda i: ~reduce(Column.__or__, [covered(i, other) for other in around]))
    return F.transform(at, lambda i: F.struct(i.alias("start"), (i + length).alias("end"), F.lit(label).alias("label")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: as a lambda variable it is not repeated wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def label_mentions(col: Column, labels: Sequence[str]) -> Column:
    """All mentions sorted by start; a shorter label inside a longer label's mention does not count.

    One pass over the text for each label that occurs in it, however many mentions there are.
    """
    ordered = sorted(labels, key=len, reverse=True)

    def find(text: Column, *marked: Column) -> Column:
        if len(marked) < len(ordered):
            return _let(_marked(text, ordered[len(marked)]), lambda chars: find(text, *marked, chars))
        spans = []
        for k, label in enumerate(ordered):
            around = [marked[j] for j in range(k) if _inside(label_words(label), label_words(ordered[j]))]
            spans.append(_spans(marked[k], label, around))
        return F.array_sort(F.concat(*spans) if spans else F.array().cast(SPAN))

    return _let(normalize_text(col), lambda text: find(text))


def parse_answer(col: Column, labels: Sequence[str]) -> Column:
    """struct(label, status): one distinct label -> parsed, none -> non_relevant, several -> ambiguous."""
    labels = list(dict.fromkeys(labels))
    words = {label: label_words(label) for label in labels}
    if any(a != b and _inside(words[a], words[b]) for a in labels for b in labels):
        seen = F.array_distinct(F.transform(label_mentions(col, labels), lambda m: m["label"]))
        distinct, only = F.size(seen), F.try_element_at(seen, F.lit(1))
    else:
        # No label can hide inside another one: presence of the words decides, a plain text search.
        padded = F.concat(F.lit(" "), normalize_text(col), F.lit(" "))
        found = {label: padded.contains(f" {' '.join(words[label])} ") for label in labels}
        distinct = reduce(Column.__add__, [f.cast("int") for f in found.values()])
        only = F.coalesce(*[F.when(f, F.lit(label)) for label, f in found.items()])
    return F.struct(
        F.when(distinct == 1, only).otherwise(F.lit(INVALID_LABEL)).alias("label"),
        F.when(distinct == 1, "parsed").when(distinct == 0, "non_relevant").otherwise("ambiguous").alias("status"),
    )
