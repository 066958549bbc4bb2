"""Ranked lexical search over an index in strata of documents with equal normaliser.

A document's normaliser m depends on its length only. Documents with equal m form a stratum; what a term adds to a score there
depends on its number of occurrences tf alone, so a posting list is kept per (stratum, term, tf) and its impact is computed once. The
largest tf of each term bounds what any document of the stratum can score for an item.

1. One pass counts the terms of every document and keeps those that the items ask for, with the length.
2. Number and lengths of documents and document frequencies give m and the weights.
3. The kept rows are dealt by ranges of (m, hash of the key), so that a stratum of any size falls to as many tasks as it needs, and
   inverted into units: slices of a stratum of at most UNIT_DOCS documents, each with its bound for every item. That is the index.
4. The unit with the highest bound is searched for each item; the k-th best score found there is what others must reach.
5. Units that can still reach it are visited in the order of their bounds; a task keeps the k best per item and passes over
   what cannot enter them. Equal bounds are visited, since a smaller key wins a tie.

Items are searched in blocks of about BLOCK_CHARS characters, whose distinct terms go to the tasks; the number of items has no limit.

Edge cases: null texts and texts without a term are no documents (they count neither for N nor for L) and, as items, find nothing. Every
row of the items is an item of its own, equal ones included; repeated documents are ranked each. Texts of any length are counted
whole. Only documents with a score above 0 are returned. Without documents or items there are no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.llm.byte_tokens import spread
from tabspark.llm.common import Scratch

#: Bytes that belong to terms: letters A-Z in lower case, digits, and whatever is not ASCII.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Between terms, as a pattern.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Parameters of the normaliser and the impact (fixed values).
BASE, SLOPE, SATURATION = 75, 25, 12
UNIT_DOCS = 1_024
BLOCK_CHARS = 4_000_000
UNIT_BITS = 33


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def impact(tf, m):
    """What an occurrence count adds, before the weight of the term."""
    return (1_000_000_000 * tf) // (1_000 * tf + SATURATION * m)


class Items:
    """The items of a block: the number of each of their terms, as one list of (term, times) per item."""

    def __init__(self, texts: list[str | None]):
        counted = [Counter(terms(t or "")) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        self.term = np.array([self.vocabulary[t] for c in counted for t in sorted(c)], np.int64)
        self.times = np.array([c[t] for c in counted for t in sorted(c)], np.int64)
        self.upto = np.cumsum([0] + [len(c) for c in counted])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each item the sum of its terms' values."""
        return np.diff(np.concatenate([[0], np.cumsum(values[self.term] * self.times)])[self.upto])


def count_terms(docs: DataFrame, key: str, text: str, held) -> DataFrame:
    """(key, n, terms, tfs) of every document with a term; terms are those of the items, by number."""

    def run(batches):
        numbers = held.value.vocabulary
        for batch in batches:
            keys, lengths, found, tfs = [], [], [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(value.as_py() or "")
                if words:
                    ids = np.array([i for i in map(numbers.get, words) if i is not None], np.int32)
                    distinct, tf = np.unique(ids, return_counts=True)
                    keys.append(k)
                    lengths.append(len(words))
                    found.append(distinct)
                    tfs.append(tf.astype(np.int32))
            lists = [_lists(x) for x in (found, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema[0].type), pa.array(lengths, pa.int64()), *lists], ["key", "n", "terms", "tfs"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]), pa.int32()))


def build_units(rows: DataFrame, held) -> DataFrame:
    """The index: per unit one row with its keys and bounds (term null), and one row per term and tf with the places of its documents.

    `rows` has key, m, terms and tfs and comes in ranges of m, each in order.
    """

    def run(batches):
        items, weights = held.value
        unit = TaskContext.get().partitionId() << UNIT_BITS
        kept: list[tuple] = []
        key_type = None

        def made():
            nonlocal unit
            m = kept[0][1]
            counts = np.array([len(x[2]) for x in kept])
            term, tf = np.concatenate([x[2] for x in kept]).astype(np.int64), np.concatenate([x[3] for x in kept]).astype(np.int64)
            slot = np.repeat(np.arange(len(kept), dtype=np.int32), counts)
            order = np.lexsort((slot, tf, term))
            term, tf, slot = term[order], tf[order], slot[order]
            new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(tf, prepend=-1))
            most = np.zeros(len(weights), np.int64)
            np.maximum.at(most, term, weights[term] * impact(tf, m))
            bounds = items.sums(most)
            n = len(new) + 1
            places = np.append(new, len(slot)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([unit] * n, pa.int64()),
                    pa.array([m] * n, pa.int64()),
                    pa.array([int(bounds.max())] * n, pa.int64()),
                    pa.array([None, *term[new].tolist()], pa.int32()),
                    pa.array([None, *tf[new].tolist()], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], places]).astype(np.int32), pa.int32()), pa.array(slot, pa.int32())),
                    pa.array([[x[0] for x in kept]] + [None] * len(new), pa.list_(key_type)),
                    pa.array([bounds.tolist()] + [None] * len(new), pa.list_(pa.int64())),
                ],
                ["unit", "m", "top", "term", "tf", "slots", "keys", "bounds"],
            )
            unit += 1

        for batch in batches:
            key_type = batch.schema[0].type
            lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in (2, 3)]
            for i, (k, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if kept and (kept[0][1] != m or len(kept) == UNIT_DOCS):
                    yield from made()
                    kept = []
                kept.append((k, m, *[values[at[i] : at[i + 1]].copy() for at, values in lists]))
        if kept:
            yield from made()

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"unit long, m long, top long, term int, tf int, slots array<int>, keys array<{kind}>, bounds array<long>"
    return rows.mapInArrow(run, schema)


def visit(units: DataFrame, held, k: int, least: np.ndarray, only: DataFrame | None = None) -> DataFrame:
    """(item, key, score): the best k of each task and item, of documents that score at least least[item].

    `units` are rows of the index; each task visits its units in the order of their highest bounds.
    """

    def run(batches):
        items, weights, least = held_least.value
        best: dict[int, list[tuple]] = {}
        floor = np.array(least, np.int64)
        unit: list[tuple] = []
        key_type = None

        def searched():
            head, rows = unit[0], unit[1:]
            m, keys, bounds = head[1], head[5], np.array(head[6], np.int64)
            wanted = np.flatnonzero((bounds >= floor) & (bounds > 0))
            if not len(wanted):
                return
            term = np.array([r[3] for r in rows], np.int64)
            gain = weights[term] * impact(np.array([r[4] for r in rows], np.int64), m)
            many = np.array([len(r[7]) for r in rows], np.int64)
            slots = np.concatenate([r[7] for r in rows])
            gains = np.repeat(gain, many)
            # Postings of term t stand at [first[t], last[t]).
            ends = np.cumsum(many)
            first, last = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
            np.maximum.at(last, term, ends)
            begins = np.flatnonzero(np.diff(term, prepend=-1))
            first[term[begins]] = (ends - many)[begins]
            for item in wanted.tolist():
                at = slice(items.upto[item], items.upto[item + 1])
                t = items.term[at]
                n = last[t] - first[t]
                place = spread(first[t], n)
                scores = np.zeros(len(keys), np.int64)
                np.add.at(scores, slots[place], gains[place] * np.repeat(items.times[at], n))
                good = np.flatnonzero(scores >= max(1, floor[item]))
                if len(good):
                    held_best = best.setdefault(item, [])
                    held_best.extend((-int(scores[g]), keys[g]) for g in good.tolist())
                    if len(held_best) > k:
                        best[item] = held_best = nsmallest(k, held_best)
                        floor[item] = max(floor[item], -held_best[-1][0])

        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            at, slots = batch.column(5).offsets.to_numpy().tolist(), batch.column(5).values.to_numpy()
            for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 6, 7)])):
                if unit and unit[0][0] != row[0]:
                    searched()
                    unit = []
                unit.append((*row, slots[at[i] : at[i + 1]]))
        if unit:
            searched()
        rows = [(item, key, -score) for item, held_best in best.items() for score, key in held_best]
        columns = list(zip(*rows)) if rows else [[], [], []]
        if key_type is not None:
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], key_type), pa.array(columns[2], pa.int64())], ["item", "key", "score"])

    held_least = units.sparkSession.sparkContext.broadcast((*held.value, least))
    kind = units.schema["keys"].dataType.elementType.simpleString()
    ordered = units.repartition("unit").sortWithinPartitions(F.desc("top"), "unit", F.asc_nulls_first("term"), "tf")
    return ordered.mapInArrow(run, f"item long, key {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k documents that score highest for each item: item_key, rank, key, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    asked = items.select(F.col(item_key).alias("item_key"), F.col(item_text).alias("item_text"))
    blocks = max(1, -(-(asked.agg(F.sum(F.length("item_text"))).first()[0] or 0) // BLOCK_CHARS))
    found = [_search_block(docs, asked.where(F.pmod(F.xxhash64("item_key", "item_text"), F.lit(blocks)) == b), k, key, text, scratch) for b in range(blocks)]
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out.select(F.col("item_key").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def _search_block(docs: DataFrame, asked: DataFrame, k: int, key: str, text: str, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    listed = asked.collect()
    items = Items([r["item_text"] for r in listed])
    names = spark.createDataFrame([(i, r["item_key"]) for i, r in enumerate(listed)], f"item long, item_key {asked.schema[0].dataType.simpleString()}")
    counted = scratch.keep(count_terms(docs, key, text, spark.sparkContext.broadcast(items)))
    n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
    frequency = np.zeros(len(items.vocabulary), np.int64)
    for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequency[row["t"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    held = spark.sparkContext.broadcast((items, weights))
    # As decimals: the product can be beyond 64 bits.
    m = F.expr(f"{BASE} + (CAST({SLOPE} * n AS DECIMAL(19,0)) * CAST({n_docs} AS DECIMAL(19,0))) div CAST({max(1, n_terms or 0)} AS DECIMAL(19,0))")
    rows = counted.where("size(terms) > 0").select("key", m.alias("m"), "terms", "tfs")
    dealt = rows.withColumn("h", F.xxhash64("key")).repartitionByRange("m", "h").sortWithinPartitions("m", "h", "key").drop("h")
    index = scratch.keep(build_units(dealt, held))
    heads = index.where("term IS NULL").select("unit", F.posexplode("bounds").alias("item", "bound"))
    first = heads.groupBy("item").agg(F.max_by("unit", F.struct("bound", "unit")).alias("unit")).select("unit").distinct()
    seeds = visit(index.join(first, "unit", "left_semi"), held, k, np.zeros(len(listed), np.int64))
    best = seeds.groupBy("item").agg(F.array_sort(F.collect_list("score")).alias("s")).where(F.size("s") >= k)
    least = np.ones(len(listed), np.int64)
    for row in best.select("item", F.expr(f"s[size(s) - {k}]").alias("least")).collect():
        least[row["item"]] = row["least"]
    reach = F.array(*[F.lit(int(x)) for x in least])
    can = index.where("term IS NULL").where(F.exists(F.zip_with("bounds", reach, lambda b, x: b >= x), lambda x: x)).select("unit")
    found = visit(index.join(can, "unit", "left_semi"), held, k, least)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_key", "rank", "key", "score")
