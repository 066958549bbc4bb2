"""Near duplicates: SuperMinHash signatures, banding, verification on whole shingle sets, and grouping.

1. Every text becomes its set of word shingles (64-bit hashes). Texts with the same set form one class, a node of the graph.
2. SuperMinHash gives each set a signature: element i offers rank j + r to the slot that its own permutation visits in step j,
   so the ranks of one element are all different; steps end as soon as no later one can lower a slot.
3. Nodes that agree in a whole band of the signature share a bucket (32 bands of 5: two sets of similarity 0.8 miss each other
   in all bands with probability 3e-6).
4. Every node gets a pivot, the node around it that meets most others (such as the text that copies were made from), and is
   compared with it on the whole sets. Links join components. Of the elements, the comparison leaves how many of the pivot's the
   node has lost, and which ones of its own it has.
5. Only pairs of different components can still change a result. If two nodes have the same pivot, they may do so only if they
   share rare elements of their own, or if what both kept of the pivot would do. What two sets share follows from what they
   share of their differences from the pivot; a bit map of each difference bounds that from above, and pairs whose bound is too
   low are left out (this is exact). In buckets with several components each node first meets one node of the bucket, the one
   closest to its pivot; only those still apart meet each other.
6. Pairs of 5 are compared on the whole sets if their signatures agree in enough slots: six standard deviations below what the
   similarity leads to, so that a pair of the similarity fails with a probability of some 1e-8. No pair is dropped otherwise.

Nothing is collected; hot buckets, hot elements and hubs are split over tasks. Lookups of sets read a bucketed table, without a
shuffle. Words are hashed by sums of byte values under coefficients without pattern.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text of fewer words than a shingle is one
shingle. Rows with equal doc_id are judged by their own texts. A null doc_id never is a component's id unless it is alone in it.
"""

from __future__ import annotations

import uuid
from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.llm.common import Scratch, byte_values, mix
from tabspark.llm.graph import components

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Bytes of a shingle hash kept in the stored sets.
KEPT = 6
#: Members of one hub that one task compares.
SPLIT = 64
#: Steps over shared buckets in which a node looks for its pivot.
PIVOT_STEPS = 2
#: Rows of one bucket, element or pivot that one task lets others meet.
MEET = 1024
#: Low bits of each slot kept for counting slots that agree, and longs for one bit of all slots.
PLANES, LONGS = 4, -(-SLOTS // 64)
#: Longs of the bit map of a difference.
MAP = 16
#: What is known of a node when two nodes meet.
KNOWN = ("comp", "n", "lost", "differs", "bits", "planes")
_CHUNK = 1 << 20


@lru_cache(maxsize=4)
def coefficients(n: int) -> np.ndarray:
    """An odd number without pattern for each place in a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range (in order, apart): the sum of its byte values times the coefficients of their places, and its length."""
    n = len(data)
    place = np.arange(n) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [n]))))
    factor = coefficients(1 << max(10, int(n).bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(byte_values()[data] * factor[place], out=sums[1:])
    return mix(sums[end] - sums[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased, split at ASCII white space)."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        part = data[at:end]
        space = (part == 32) | ((part >= 9) & (part <= 13))
        while end < len(data) and not space.any():  # one word longer than the chunk
            end = min(len(data), end + (end - at))
            part = data[at:end]
            space = (part == 32) | ((part >= 9) & (part <= 13))
        if end < len(data):
            last = len(part) - int(np.argmax(space[::-1]))
            part, space, end = part[:last], space[:last], at + last
        edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
        out.append(range_hashes(part, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; fewer words are one run."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    count = max(1, len(words) - size + 1)
    used = min(size, len(words))
    total = np.full(count, used, dtype=np.uint64)
    for k in range(used):
        total = total * np.uint64(0x9FB21C651E98DF25) + words[k : k + count]
    return np.unique(mix(total))


def super_min_hash(x: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Rank (step in the high bits, random value in the low 40) of each slot over the elements."""
    out = np.full(slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    order, row = None, np.arange(len(x))
    for step in range(slots):
        drawn = mix(x + np.uint64((step + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((drawn >> np.uint64(40)) * np.uint64(slots - step) >> np.uint64(24)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            slot = order[row, pick]
            order[row, pick] = order[:, step]
        np.minimum.at(out, slot, (drawn & np.uint64((1 << 40) - 1)) | np.uint64(step << 40))
        if out.max() < np.uint64((step + 1) << 40):
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), 1))
            order[row, pick] = 0
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        total = mix(total) + column
    return mix(total).view(np.int64)


def bit_planes(signature: np.ndarray) -> np.ndarray:
    """The low PLANES bits of every slot, bit by bit, in longs."""
    bits = np.zeros((PLANES, 64 * LONGS), dtype=np.uint8)
    bits[:, : len(signature)] = (signature[None, :] >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits, axis=1).reshape(-1).view(np.int64)


def agreement() -> str:
    """SQL: in how many slots the signatures of two nodes (planes, other_planes) may agree."""
    parts = (" | ".join(f"(planes[{k * LONGS + i}] ^ other_planes[{k * LONGS + i}])" for k in range(PLANES)) for i in range(LONGS))
    return f"{SLOTS} - " + " - ".join(f"bit_count({p})" for p in parts)


def least_agreement(percent: int) -> int:
    """Slots that agree for two sets of the similarity, but for a chance of some 1e-8."""
    p = percent / 100 + (1 - percent / 100) / (1 << PLANES)
    return int(SLOTS * p - 6 * sqrt(SLOTS * p * (1 - p)))


def difference_map(lost: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Bit map of the elements in which a set differs from its hub."""
    bits = np.zeros(64 * MAP, dtype=np.uint8)
    bits[(mix(np.concatenate([lost << np.uint64(1), (own << np.uint64(1)) + np.uint64(1)]) + np.uint64(1)) % np.uint64(64 * MAP)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def node_of(x: np.ndarray) -> int:
    """Digest of a set: of the sum of its mixed elements and its size."""
    total = np.array([len(x)], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix(x + np.uint64(1)).sum(dtype=np.uint64)
    return int(mix(total).view(np.int64)[0])


def pack(x: np.ndarray) -> bytes:
    """Sorted set of the low KEPT bytes."""
    low = np.unique(x & np.uint64((1 << 8 * KEPT) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // KEPT, 8), dtype=np.uint8)
    out[:, :KEPT] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, KEPT)
    return out.reshape(-1).view("<u8")


def sketch(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(doc_id, text_hash, n, node, bands, planes) of each row; the last three are null without shingles."""

    def run(batches):
        for batch in batches:
            n, node, bands, planes = [], [], [], []
            for value in batch.column(2).to_pylist():
                x = shingle_set(value, size)
                n.append(len(x))
                node.append(node_of(x) if len(x) else None)
                signature = super_min_hash(x) if len(x) else None
                bands.append(band_keys(signature) if len(x) else None)
                planes.append(bit_planes(signature) if len(x) else None)
            longs = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs], ["doc_id", "text_hash", "n", "node", "bands", "planes"])

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, node long, bands array<long>, planes array<long>")


def stored_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, size: int, table: str, path: str) -> DataFrame:
    """Sets of the wanted rows (doc_id, text_hash, node) as a table bucketed by node, so that lookups by node do not shuffle it."""

    def run(batches):
        for batch in batches:
            seen = set()
            node, n, blob = [], [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    x = shingle_set(value, size)
                    node.append(k)
                    n.append(len(x))
                    blob.append(pack(x))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], ["node", "n", "blob"])

    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "node")
    joined = rows.join(wanted, (F.col("text_hash") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = joined.mapInArrow(run, "node long, n long, blob binary").repartition(buckets, "node").dropDuplicates(["node"])
    sets.write.bucketBy(buckets, "node").sortBy("node").option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def compare(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, difference: bool = False) -> DataFrame:
    """The pairs (node, hub) whose sets reach the similarity; with difference, all pairs with what tells the node from the hub.

    Then there are also `linked`, hub_n (size of the hub's set), lost (how many of its elements the node lacks), own (the
    node's elements that the hub lacks) and bits (the map of both). Members meet a copy of their hub's set in slices of about SPLIT members, and pass one
    by one through the task.
    """

    def run(batches):
        current, hub_set = None, None
        for batch in batches:
            out = []
            for h, part, m, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if m is None:
                    current, hub_set = (h, part), unpack(blob)
                elif current == (h, part):
                    x = unpack(blob)
                    common = len(np.intersect1d(x, hub_set, assume_unique=True))
                    linked = 100 * common >= percent * (len(x) + len(hub_set) - common)
                    if difference:
                        own, gone = np.setdiff1d(x, hub_set, assume_unique=True), np.setdiff1d(hub_set, x, assume_unique=True)
                        out.append((m, h, linked, len(hub_set), len(gone), own.astype(np.int64), difference_map(gone, own)))
                    elif linked:
                        out.append((m, h))
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))

    kinds = {"node": pa.int64(), "hub": pa.int64()}
    schema = "node long, hub long"
    if difference:
        kinds |= {"linked": pa.bool_(), "hub_n": pa.int64(), "lost": pa.int64(), "own": pa.list_(pa.int64()), "bits": pa.list_(pa.int64())}
        schema += ", linked boolean, hub_n long, lost long, own array<long>, bits array<long>"
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPLIT).alias("parts"))
    parted = pairs.join(counts, "hub").select("node", "hub", F.pmod(F.xxhash64("node", "hub"), "parts").alias("part"))
    members = parted.join(sets, "node").select("hub", "part", F.col("node").alias("member"), "blob")
    hubs = counts.join(sets, F.col("hub") == F.col("node")).select(
        "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("member"), "blob"
    )
    rows = members.union(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("member"))
    return scratch.keep(rows.mapInArrow(run, schema))


def relabel(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, comp, ...) after joining the components that the links (node, hub) connect."""
    at = labels.select("node", "comp")
    ends = links.join(at, "node").select(F.col("hub").alias("node"), F.col("comp").alias("u")).join(at, "node").select("u", F.col("comp").alias("v"))
    roots = components(ends.distinct(), scratch).select(F.col("node").alias("comp"), "root")
    return scratch.keep(labels.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (doc_id = component_id) and text_hash of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = scratch.keep(sketch(docs, key, text, size))
    classes = scratch.keep(
        rows.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash", "bands", "planes")).alias("r"))
    )
    members = classes.select("node", F.explode("r.bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    buckets = scratch.keep(members.join(shared, "bucket"))
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("r.doc_id", "r.text_hash", "node")
    table = f"near_dedup_sets_{uuid.uuid4().hex}"
    try:
        sets = stored_sets(docs, wanted, key, text, size, table, f"{scratch.root}/sets")
        labels = _link(buckets, sets, classes.select("node", "r.planes"), percent, scratch)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    grouped = classes.join(labels.select("node", "comp"), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "first_id")
    least = grouped.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    found = grouped.join(least, "comp").select("node", "component_id")
    out = rows.join(found, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_hash",
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def pivots(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, pivot): the node that meets most others in buckets, among those that buckets lead to in PIVOT_STEPS steps."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"))
    met = buckets.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("met"))
    best = met.select("node", F.struct("met", "node").alias("p"))
    for _ in range(PIVOT_STEPS):
        at = scratch.keep(buckets.join(best, "node"))
        best = at.drop("p").join(at.groupBy("bucket").agg(F.max("p").alias("p")), "bucket").groupBy("node").agg(F.max("p").alias("p"))
    return scratch.keep(best.select("node", F.col("p.node").alias("pivot")))


def meet(left: DataFrame, right: DataFrame, on: list[str], condition: str) -> DataFrame:
    """Pairs (node, hub) of rows of both sides with equal `on` that fulfil the condition, each pair once, the smaller name first.

    What is larger than MEET rows of the right side is dealt to several tasks, to each of which the left side goes.
    """
    parts = right.groupBy(*on).agg(F.ceil(F.count("*") / MEET).alias("parts"))
    dealt = right.join(parts, on).withColumn("part", F.pmod(F.xxhash64("hub"), F.col("parts"))).drop("parts")
    sent = left.join(parts, on).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    found = sent.join(dealt, [*on, "part"]).where(condition)
    return found.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub")).distinct()


def _link(buckets: DataFrame, sets: DataFrame, planes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, comp) of all nodes of the buckets."""
    share = f"{percent / (100 + percent)!r}"
    labels = scratch.keep(sets.select("node", F.col("node").alias("comp"), "n").join(pivots(buckets, scratch), "node"))
    to_pivot = compare(labels.where("node <> pivot").select("node", F.col("pivot").alias("hub")), sets, percent, scratch, difference=True)
    labels = relabel(labels, to_pivot.where("linked").select("node", "hub"), scratch)
    # Every node next to its pivot; the pivot itself differs in nothing.
    nothing, blank = F.array().cast("array<long>"), F.array_repeat(F.lit(0).cast("long"), MAP)
    near = labels.join(to_pivot.drop("hub"), "node", "left").withColumns(
        {
            "linked": F.coalesce("linked", F.lit(True)),
            "hub_n": F.coalesce("hub_n", "n"),
            "lost": F.coalesce("lost", F.lit(0)),
            "own": F.coalesce("own", nothing),
            "bits": F.coalesce("bits", blank),
        }
    )
    near = near.join(near.groupBy("pivot").agg(F.min("n").alias("least_n")), "pivot").join(planes, "node")
    near = scratch.keep(near.withColumn("differs", F.col("lost") + F.size("own")))
    fits = f"comp <> other AND 100 * least(n, other_n) >= {percent} * greatest(n, other_n) AND {agreement()} >= {least_agreement(percent)}"
    # Of one pivot: what the sets share is hub_n - lost - other_lost and what their differences share.
    more = f"{share} * (n + other_n) - hub_n + lost + other_lost - 1e-6"
    beyond = " + ".join(f"bit_count(bits[{i}] & ~other_bits[{i}])" for i in range(MAP))
    beyond_other = " + ".join(f"bit_count(other_bits[{i}] & ~bits[{i}])" for i in range(MAP))
    bound = f"differs - ({beyond}) >= {more} AND other_differs - ({beyond_other}) >= {more}"

    def other(df: DataFrame, *columns: str, also: tuple[str, ...] = ()) -> DataFrame:
        renamed = {"node": "hub", "comp": "other"}
        return df.select(*columns, *[F.col(c).alias(renamed.get(c, f"other_{c}")) for c in ("node", *KNOWN)], *[F.col(c).alias(f"other_{c}") for c in also])

    # 1. Two nodes that share elements which their pivot lacks: the rarest of these are enough, so common ones seldom count.
    need = F.expr(f"greatest(1, ceil({share} * (n + least_n) - 1e-6) - (hub_n - lost))")
    listed = near.select("pivot", "node", need.alias("need"), F.size("own").alias("size"), F.explode("own").alias("x"))
    held = listed.groupBy("pivot", "x").agg(F.count("*").alias("k"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("k", "x"))
    rare = listed.join(held, ["pivot", "x"]).withColumn("place", place).where("place <= size - need + 1 AND k > 1")
    rare = scratch.keep(rare.select("pivot", "x", "node").join(near.select("node", "hub_n", *KNOWN), "node"))
    alike = meet(rare, other(rare, "pivot", "x"), ["pivot", "x"], f"node < hub AND {fits} AND {bound}")
    # 2. Two nodes that share elements of the pivot only. One of them is not linked to it; then the other is smaller than it.
    close = near.where(f"lost <= hub_n - {share} * (n + least_n) + 1e-6").select("pivot", "node", "hub_n", "linked", *KNOWN)
    both_keep = f"greatest(lost, other_lost) <= hub_n - {share} * (n + other_n) + 1e-6"
    inside = meet(close.where("NOT linked"), other(close.where("n < hub_n"), "pivot"), ["pivot"], f"{both_keep} AND {fits} AND {bound}")
    links = compare(scratch.keep(alike.union(inside).distinct()), sets, percent, scratch)
    labels = relabel(labels, links, scratch)
    # 3. Nodes of one bucket: first with its node that is closest to a pivot, then those still apart that have different pivots.
    known = near.drop("comp", "own", "least_n", "linked")

    def apart(here: DataFrame) -> DataFrame:
        several = here.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        return scratch.keep(here.join(several, "bucket"))

    here = apart(buckets.join(known.join(labels.select("node", "comp"), "node"), "node"))
    middle = here.groupBy("bucket").agg(F.min(F.struct("lost", "node")).alias("m")).select("bucket", F.col("m.node").alias("node"))
    first = meet(here, other(here.join(middle, ["bucket", "node"]), "bucket", also=("pivot",)), ["bucket"], f"pivot <> other_pivot AND {fits}")
    labels = relabel(labels, compare(scratch.keep(first), sets, percent, scratch), scratch)
    here = apart(here.drop("comp").join(labels.select("node", "comp"), "node"))
    rest = meet(here, other(here, "bucket", also=("pivot",)), ["bucket"], f"pivot < other_pivot AND {fits}")
    return relabel(labels, compare(scratch.keep(rest), sets, percent, scratch), scratch)
