"""Repeated byte strings of a fixed length, by a depth-limited radix sort that starts with the most significant digit.

What is sorted are the windows of LENGTH bytes of all texts (suffixes, cut at the threshold). Their digits are taken in an order
that every window settles for itself, so that neighbours can move together: the first digit is the window's smallest gram
(24 bytes), and the next ones widen around it, to 169, 193 and all 200 bytes. Windows of one text that share the gram travel as
one row (`bundle`) with the hash of the bytes that all of them contain (`core`, the digits so far) and of the bytes that they
cover together (`cover`). A pass groups rows by core:

* a core that occurs once holds no repeated window, and leaves;
* rows of equal cover are equal window by window: they are repeated, and one of them goes on for all;
* cores with several covers, at least one of them alone, are split into narrower rows and go on to the next pass.

After the last pass a row is one window and its core is the whole window: equal groups are exactly the repeated windows.
Digits are compared by 64-bit hashes. Rows of equal content are merged map-side before the shuffle, so a passage that many
texts share reaches its group as a few rows; a row is a text's windows around one gram, about 70 of them.

Edge cases: a null or empty text has no bytes; texts shorter than LENGTH keep everything. Matches never cross texts. Overlapping
repeats inside one text count. Repeated rows are repeats of each other and are all returned.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.llm.common import BLOCK, ByteHash, Scratch, mix

LENGTH = 200
#: Bytes of the first digit.
GRAM = 24
#: Offsets that one row spans in the passes after the first.
WIDTHS = (32, 8, 1)
_PLACE = np.dtype([("row", "<i8"), ("at", "<i4")])
_ROWS = "core long, cover long, shape int, n long, places binary"


def sliding_argmin(values: np.ndarray, length: int) -> np.ndarray:
    """Leftmost position of the smallest value (by its high 45 bits) in each window of the length."""
    mask = np.uint64((1 << 19) - 1)
    low = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= length:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = length - span
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & mask).astype(np.int64)


def bundles(data: np.ndarray, length: int):
    """Arrays for each block of a text: start of a bundle's first window, number of its windows, offset of the gram in the
    first window, core and cover."""
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        hashes = ByteHash(part)
        grams = hashes.windows(GRAM)
        gram_at = sliding_argmin(grams, length - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], gram_at[1:] != gram_at[:-1])))
        after = np.concatenate((first[1:], [len(gram_at)]))
        offset = gram_at[first] - first
        cover = hashes.ranges(first, after - 1 + length) + offset.astype(np.uint64)
        yield first + at, after - first, offset, grams[gram_at[first]], cover


def narrower(data: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray, width: int, length: int):
    """The rows of one text, cut at multiples of `width` of the offset: index of the row, start, count, offset, core, cover."""
    for at in range(0, len(data), BLOCK):
        mine = np.flatnonzero((start >= at) & (start < at + BLOCK))
        if not len(mine):
            continue
        hashes = ByteHash(data[at : at + BLOCK + 4 * length])
        gram = start[mine] + offset[mine] - at
        low, high = offset[mine] - count[mine] + 1, offset[mine]
        parts = high // width - low // width + 1
        row = np.repeat(np.arange(len(mine)), parts)
        cell = (low // width)[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        a, b = np.maximum(low[row], cell * width), np.minimum(high[row], cell * width + width - 1)
        first, last = gram[row] - b, gram[row] - a
        widest = np.minimum(cell * width + width - 1, length - GRAM)
        core = hashes.ranges(gram[row] - cell * width, gram[row] - widest + length) + mix(cell.astype(np.uint64))
        cover = hashes.ranges(first, last + length) + b.astype(np.uint64)
        yield mine[row], first + at, b - a + 1, b, core, cover


def rows_of(core, cover, shape, n, row, at) -> pa.RecordBatch:
    """One row for each distinct content, with its places."""
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (core, cover, shape, n, row, at)]
    core, cover, shape, n = columns[0].astype(np.uint64).view(np.int64), columns[1].astype(np.uint64).view(np.int64), columns[2], columns[3]
    order = np.lexsort((cover, core))
    core, cover = core[order], cover[order]
    places = np.empty(len(order), dtype=_PLACE)
    places["row"], places["at"] = columns[4][order], columns[5][order]
    first = np.flatnonzero(np.concatenate(([True], (core[1:] != core[:-1]) | (cover[1:] != cover[:-1])))) if len(order) else order
    ends = np.concatenate((first, [len(order)])).astype(np.int32) * _PLACE.itemsize
    total = np.add.reduceat(n[order], first) if len(order) else n
    blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(places.tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array(core[first]), pa.array(cover[first]), pa.array(shape[order][first].astype(np.int32)), pa.array(total.astype(np.int64)), blob],
        ["core", "cover", "shape", "n", "places"],
    )


def first_pass(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(value.as_buffer() or b"", dtype=np.uint8)
                for start, count, offset, core, cover in bundles(data, length):
                    for x, y in zip(out, (core, cover, count << 10 | offset, np.ones(len(start), np.int64), np.full(len(start), row), start)):
                        x.append(y)
            yield rows_of(*out)

    return texts.select("row", "text").mapInArrow(run, _ROWS)


def next_pass(texts: DataFrame, going: DataFrame, width: int, length: int) -> DataFrame:
    """Narrower rows for the rows (row, at, shape, n) that go on; texts are looked up without a shuffle of them."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for value, row, bundle in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                data = np.frombuffer(value.as_buffer(), dtype=np.uint8)
                at, shape, n = (bundle.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                for index, start, count, offset, core, cover in narrower(data, at, shape >> 10, shape & 1023, width, length):
                    for x, y in zip(out, (core, cover, count << 10 | offset, n[index], np.full(len(start), row), start)):
                        x.append(y)
            yield rows_of(*out)

    by_text = going.groupBy("row").agg(F.collect_list(F.struct("at", "shape", "n")).alias("bundles"))
    return texts.join(by_text, "row").select("text", "row", "bundles").mapInArrow(run, _ROWS)


def passed(rows: DataFrame) -> DataFrame:
    """What is known after the pass: places and shape of rows that are `repeated`, and of those that are to be split (`goes`)."""
    core, cover = Window.partitionBy("core"), Window.partitionBy("core", "cover")
    rows = rows.withColumns({"cover_n": F.sum("n").over(cover), "turn": F.row_number().over(cover.orderBy("places"))})
    rows = rows.withColumns(
        {"core_n": F.sum("n").over(core), "lo": F.min("cover").over(core), "hi": F.max("cover").over(core), "alone": F.min("cover_n").over(core)}
    )
    out = rows.where("core_n > 1").select(
        "places", "shape", (F.col("cover_n") > 1).alias("repeated"), F.expr("lo < hi AND alone = 1 AND turn = 1").alias("goes")
    )
    return out.where("repeated OR goes")


def spread(rows: DataFrame, only_first: bool) -> DataFrame:
    """(row, at, shape, n) of all places of the rows, or of their first place; n is 2 for repeated rows."""

    def run(batches):
        for batch in batches:
            row, at, shape, n = [], [], [], []
            for blob, s, repeated in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                places = np.frombuffer(blob.as_buffer(), dtype=_PLACE)[: 1 if only_first else None]
                row.append(places["row"])
                at.append(places["at"])
                shape.append(np.full(len(places), s, np.int32))
                n.append(np.full(len(places), 2 if repeated else 1, np.int32))
            columns = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (row, at, shape, n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["row", "at", "shape", "n"]
            )

    return rows.select("places", "shape", "repeated").mapInArrow(run, "row long, at int, shape int, n int")


def removed_runs(n: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of n bytes."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    covered = np.concatenate(([0], (np.cumsum(change[:n]) > 0).view(np.int8), [0]))
    edge = np.diff(covered)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """The key, n_bytes, n_removed, n_spans and kept_sha256 of each row, and with with_text the remaining bytes as `kept`.

    Texts are written once, bucketed by row, so that no pass shuffles them again.
    """
    if not GRAM < length <= 1000:
        raise ValueError("the length must be above 24 and at most 1000 bytes")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    table = f"suffix_dedup_texts_{uuid.uuid4().hex}"
    kind = docs.schema[key].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    whole.repartition(parts, "row").write.bucketBy(parts, "row").option("compression", "zstd").saveAsTable(table)
    try:
        texts = spark.table(table)
        found = [scratch.keep(passed(first_pass(texts, length)))]
        for width in WIDTHS:
            going = spread(found[-1].where("goes"), only_first=True)
            found.append(scratch.keep(passed(next_pass(texts, going, width, length))))
        runs = spread(found[0].where("repeated"), only_first=False)
        for later in found[1:]:
            runs = runs.union(spread(later.where("repeated"), only_first=False))
        by_text = runs.groupBy("row").agg(F.collect_list(F.struct("at", "shape")).alias("runs"))

        def run(batches):
            for batch in batches:
                out = []
                for value, spans in zip(batch.column(1), batch.column(2)):
                    raw = value.as_buffer() or b""
                    data = np.frombuffer(raw, dtype=np.uint8)
                    at = shape = np.zeros(0, np.int64)
                    if spans.is_valid:
                        at, shape = (spans.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                    a, b = removed_runs(len(data), at, at + (shape >> 10) - 1 + length)
                    view, last, kept = memoryview(raw), 0, []
                    for x, y in zip(a.tolist(), b.tolist()):
                        kept.append(view[last:x])
                        last = y
                    kept = b"".join([*kept, view[last:]])
                    out.append((len(data), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                columns = list(zip(*out)) if out else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

        joined = texts.join(by_text, "row", "left").select("key", "text", "runs")
        out = scratch.keep(
            joined.mapInArrow(run, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
            .withColumnRenamed("key", key).select(key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
        )
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return out
