"""Line deduplication by winnowing over line hashes. DataFrame functions only.

Lines are compared with white space collapsed; blank lines take no part. A run of lines with at least MIN_WORDS words that also
occurs at an earlier place (by key, then text hash, then line) is deleted whole; the first place stays.

A window is a run of that many words that would have too few without its last or without its first line: the shortest one that
begins, or ends, at a line. Its fingerprint is the smallest line hash in it, so every repeated window shares a fingerprint at
its place in each copy. Fingerprints that occur at one place only are dropped. Around the others, all windows over the
fingerprint are joined by content to the first place of that content, so no pairs of copies are made. The matches extend both
ways through these windows: in a repeated run each line stands in the shortest window that begins at the run's first line, or
in the one that ends at the line itself, and both lie in the run. So what is deleted is exactly the repeated runs.

Edge cases: null and empty texts have no lines to delete and pass unchanged. Runs of fewer than MIN_WORDS words stay. A run that
repeats inside one text loses its later places. Rows with equal key and text count as one place and get equal results. All
other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import Scratch

MIN_WORDS = 50
SALTS = 16
LINES = 1 << 31  # more lines than an array can hold
SPACE = r"[\x09-\x0D\x20]+"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def counted_lines(lines: Column) -> Column:
    """Place, hash and number of words of the lines that are not blank."""

    def line(x: Column, i: Column) -> Column:
        plain = F.trim(F.regexp_replace(x, SPACE, " "))
        words = F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1)
        return F.struct(i.alias("i"), F.xxhash64(plain).alias("h"), words.alias("n"))

    return F.filter(F.transform(lines, line), lambda x: x["n"] > 0)


def word_owners(lines: Column) -> Column:
    """For every word of the text the number (from 1) of the line that it stands in."""
    return F.flatten(F.transform(lines, lambda x, i: F.array_repeat(i + 1, x["n"])))


def window_ends(owners: Column, min_words: int) -> Column:
    """First and last line, as one long, of the windows: of `min_words` words in a row that begin or end with a line."""
    last = F.size(owners) - min_words
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def at_border(p: Column) -> Column:
        begins = ~F.get(owners, p - 1).eqNullSafe(F.get(owners, p))
        return begins | ~F.get(owners, p + min_words).eqNullSafe(F.get(owners, p + (min_words - 1)))

    ends = F.transform(F.filter(starts, at_border), lambda p: F.get(owners, p).cast("long") * LINES + F.get(owners, p + (min_words - 1)))
    return F.array_distinct(ends)


def line_windows(ends: Column, hashes: Column) -> Column:
    """Of each window: start (from 1), count, hash of the content, fingerprint and its place."""

    def part(x: Column) -> Column:
        start, end = F.floor(x / LINES).cast("int"), (x % LINES).cast("int")
        return F.struct(start.alias("start"), F.slice(hashes, start, end - start + 1).alias("part"))

    def window(x: Column) -> Column:
        low = F.array_min(x["part"])
        place = x["start"] - 1 + F.array_position(x["part"], low).cast("int")
        return F.struct(x["start"].alias("start"), F.size(x["part"]).alias("count"), F.xxhash64(x["part"]).alias("content"), low.alias("low"), place.alias("at"))

    return F.transform(F.transform(ends, part), window)


def later_runs(docs: DataFrame, key: str, text: str, min_words: int, scratch: Scratch) -> DataFrame:
    """(key, row, start, count) of every window whose content also occurs at an earlier place; `row` is the hash of the text."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), counted_lines(split_lines(F.col(text))).alias("l"))
    # Steps, each used more than once by the next, so that Spark computes them once for a row.
    rows = rows.select("key", "row", F.transform("l", lambda x: x["h"]).alias("h"), word_owners(F.col("l")).alias("owners"))
    rows = rows.select("key", "row", "h", window_ends(F.col("owners"), min_words).alias("ends"))
    # The outer form keeps Spark from adding a filter that would compute every window twice.
    windows = rows.select("key", "row", F.explode_outer(line_windows(F.col("ends"), F.col("h"))).alias("x")).where("x IS NOT NULL")
    marks = windows.groupBy("key", "row", F.col("x.low").alias("mark"), F.col("x.at").alias("at")).agg(
        F.collect_list(F.struct("x.start", "x.count", "x.content")).alias("around")
    )
    marks = scratch.keep(marks)
    common = marks.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark")
    near = marks.join(common, "mark").select("key", "row", F.explode("around").alias("x")).select("key", "row", "x.start", "x.count", "x.content")
    place = F.struct("key", "row", "start")
    near = scratch.keep(near)
    first = near.groupBy("content").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    # A passage that many texts share meets its first place in SALTS tasks.
    first = first.select("content", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = near.withColumn("salt", F.pmod(F.xxhash64("key", "row", "start"), F.lit(SALTS)).cast("int"))
    return salted.join(first, ["content", "salt"]).where(place > F.col("first")).select("key", "row", "start", "count")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, into: str = "lines") -> DataFrame:
    """All rows and columns, with a struct `into`: n_lines, n_removed and the remaining text."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    runs = later_runs(docs, key, text, min_words, scratch)
    gone = runs.groupBy("key", "row").agg(F.collect_set(F.struct("start", "count")).alias("__runs"))
    gone = gone.withColumnsRenamed({"key": "__key", "row": "__row"})
    lines = split_lines(F.coalesce(F.col(text), F.lit("")))
    numbered = F.flatten(F.transform("__runs", lambda r: F.sequence(r["start"], r["start"] + r["count"] - 1)))
    # The expressions stand in steps, each used more than once by the next, so that Spark computes them once for a row.
    place = F.transform(F.array_distinct(numbered), lambda k: F.element_at(F.col("__counted"), k)["i"])
    places = F.when(F.size("__counted") > 0, place)
    joined = docs.join(gone, (F.xxhash64(F.col(text)) == F.col("__row")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    steps = joined.withColumn("__lines", lines)
    steps = steps.withColumn("__counted", F.when(F.col("__runs").isNotNull(), counted_lines(F.col("__lines"))))
    steps = steps.withColumn("__places", F.when(F.col("__runs").isNotNull(), places))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__places")
    kept = F.array_join(F.transform(left, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n")
    out = F.struct(
        F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(F.col("__runs").isNull(), 0).otherwise(F.size("__places")).cast("long").alias("n_removed"),
        F.when(F.col("__runs").isNull(), F.col(text)).otherwise(kept).alias("kept"),
    )
    # As the output of a generator the struct is made once, whatever is selected or filtered from it later.
    return steps.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode_outer(F.array(out)).alias(into))
