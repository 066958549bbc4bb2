"""Benchmark decontamination with a broadcast hash set of normalised test n-grams. DataFrame functions only.

Words are runs of letters and digits after A-Z are lower-cased. Every benchmark item gives its windows of SIZE words (an item of
fewer words is one window). Documents are cut into words once; the hash of the window at every word is looked up in the
broadcast set, and hits are verified word by word before they count. The set is broadcast in parts of at most BOUND windows:
a larger benchmark means more parts, each a further pass over the documents.

Edge cases: null and empty texts have no words and no hits. Items without words have no windows; hits of items without item_id
count as hit words only. Repeated items count once. Repeated rows get equal results. An empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import LOWER, UPPER

SIZE = 10
BOUND = 500_000
#: What stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def _window_starts(words: Column, size: Column) -> Column:
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))


def windows(benchmark: DataFrame, size: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: hash, words, their number, and the ids of the items that hold them."""
    items = benchmark.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    at = items.select("item", "words", length.alias("len"), F.explode_outer(_window_starts(F.col("words"), length)).alias("i"))
    grams = at.select("item", "len", F.slice("words", F.col("i"), F.col("len")).alias("gram"))
    return grams.groupBy("gram", "len").agg(F.collect_set("item").alias("items")).select(F.xxhash64("gram").alias("hash"), "gram", "len", "items")


def hits(docs: DataFrame, grams: DataFrame, text: str, row: Column) -> DataFrame:
    """(row, start, len, items) for each verified occurrence of a window."""
    sizes = grams.groupBy("len").count().collect()  # at most one row for each number of words
    total = sum(r["count"] for r in sizes)
    parts = max(1, -(-total // BOUND))
    words = docs.select(row.alias("row"), words_of(F.col(text)).alias("words"))
    out = None
    for r in sizes:
        n = int(r["len"])
        hashed = words.withColumn("h", F.transform(_window_starts(F.col("words"), F.lit(n)), lambda i: F.xxhash64(F.slice("words", i, n))))
        # The outer form keeps Spark from adding a filter that would compute every window twice.
        looked = hashed.select("row", "words", F.posexplode_outer("h").alias("start", "h"))
        for part in range(parts):
            some = grams.where(F.col("len") == n)
            some = some.where(F.pmod("hash", F.lit(parts)) == part) if parts > 1 else some
            found = looked.join(F.broadcast(some), looked["h"] == some["hash"])
            # Equality in two halves, so that the join's key stays the one long.
            here = F.slice("words", F.col("start") + 1, n)
            found = found.where((here <= F.col("gram")) & (here >= F.col("gram"))).select("row", "start", "len", "items")
            out = found if out is None else out.union(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The key, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    grams = windows(benchmark, size)
    row = F.xxhash64(F.col(key), F.col(text))
    rows = docs.select(row.alias("row"), F.col(key), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    found = hits(docs, grams, text, row)
    nothing = F.array().cast("array<string>")
    if found is None:
        rows = rows.withColumns({"n_hit": F.lit(0).cast("long"), "items": nothing})
    else:
        covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
        per_row = found.groupBy("row").agg(
            F.collect_set(F.struct("start", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
        )
        per_row = per_row.select("row", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), "items")
        rows = rows.join(per_row, "row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", nothing)})
    return rows.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows, with all columns, whose text holds no window of the benchmark."""
    row = F.xxhash64(F.col(key), F.col(text))
    found = hits(docs, windows(benchmark, size), text, row)
    if found is None:
        return docs
    bad = found.select(F.col("row").alias("__bad")).distinct()
    return docs.join(bad, row == F.col("__bad"), "left_anti")
