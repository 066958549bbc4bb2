"""Hierarchical packing of documents into training sequences of several context sizes.

Every document is its ids and an end id. Windows of the longest context are cut from it while it fills them; the rest is routed to
the smallest context size (tier) that holds it whole. Tiers are packed from the longest: a window takes the longest rest routed
to it, then its gap is filled with the longest whole rests of shorter tiers that fit, and what is still open is closed with
the head of one more rest, whose tail is routed anew. Every window is thus full. The sequences of a tier are ordered by their
attention cost (sum of squared piece lengths) and dealt, in that order, into step groups of STEP_TOKENS tokens, so that the
sequences of one training step have one context size and about equal cost.

Each task packs the documents it reads, in blocks of about BLOCK_TOKENS tokens; what a block leaves open stays for the next
one, and the last few rests of a task go into full windows of falling powers of two. There is no padding and no shuffle, and a
task that is run again packs the same rows alike: numbers of sequences and steps begin with the number of the partition.

Edge cases: a null text counts as empty, and an empty text is its end id alone. Repeated rows are packed each by itself. Texts of
any length are cut into windows one after another. Of other columns nothing is read. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.byte_tokens import ByteTokens, WordTable, in_groups

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 16_384
BLOCK_TOKENS = 4_000_000
#: Id of the end of a document (fixed value).
END = 1
_TABLES: dict[int, WordTable] = {}
#: Bits below the number of the partition in numbers of sequences and steps.
LOCAL_BITS = 36


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def split(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Rests:
    """Pieces by length, with the longest of at most a given length at hand."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths = 0  # bit n is set where pieces of n ids are held
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.by_length.setdefault(n, []).append(piece)
        self.lengths |= 1 << n
        self.tokens += n

    def longest(self, most: int) -> int:
        """Length of the longest piece of at most `most` ids, 0 without one."""
        return max(0, (self.lengths & ((2 << most) - 1)).bit_length() - 1)

    def take(self, n: int) -> Piece:
        held = self.by_length[n]
        piece = held.pop()
        if not held:
            self.lengths ^= 1 << n
        self.tokens -= n
        return piece


class Packer:
    """Packs the documents of one task."""

    def __init__(self, first: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool = False):
        self.tiers = tuple(sorted(tiers, reverse=True))
        if not tiers or any(t < 1 or t & (t - 1) for t in tiers):
            raise ValueError("context sizes must be powers of two")
        self.step_tokens, self.with_ids = step_tokens, with_ids
        self.rests = Rests()
        self.added = 0
        self.waiting: dict[int, list[tuple[int, list[Piece]]]] = {}
        self.next_sequence = self.next_step = first

    def add(self, doc, ids: np.ndarray) -> None:
        top, total = self.tiers[0], len(ids)
        self.added += total
        whole = total // top * top
        for at in range(0, whole, top):
            self._full(top, [Piece(doc, at, ids[at : at + top], total)])
        if whole < total:
            self.rests.put(Piece(doc, whole, ids[whole:].copy(), total))

    def _full(self, size: int, pieces: list[Piece]) -> None:
        cost = sum(len(p.ids) ** 2 for p in pieces)
        rows = [(p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, p.ids if self.with_ids else None) for p in pieces]
        self.waiting.setdefault(size, []).append((cost, rows))

    def _window(self, size: int, first: int) -> None:
        """One full window that begins with a rest of `first` ids; the rests hold at least `size` ids."""
        pieces, gap = [self.rests.take(first)], size - first
        while gap:
            if n := self.rests.longest(gap):
                piece = self.rests.take(n)
            else:  # nothing fits whole: the head of the shortest rest closes the gap
                shortest = (self.rests.lengths & -self.rests.lengths).bit_length() - 1
                piece, tail = self.rests.take(shortest).split(gap)
                self.rests.put(tail)
            pieces.append(piece)
            gap -= len(piece.ids)
        self._full(size, pieces)

    def pack(self, last: bool) -> None:
        for size in self.tiers:
            while self.rests.tokens >= size and (n := self.rests.longest(size)) and (n > size // 2 or size == self.tiers[-1]):
                self._window(size, n)
        if not last:
            return
        while self.rests.tokens:
            size = min(self.tiers[0], 1 << (self.rests.tokens.bit_length() - 1))
            n = self.rests.longest(size)
            if not n:
                n = self.rests.longest(2 * self.tiers[0])
                head, tail = self.rests.take(n).split(size)
                self.rests.put(head)
                self.rests.put(tail)
                n = size
            self._window(size, n)

    def steps(self, last: bool) -> Iterator[tuple]:
        """Rows of the sequences whose step group is full, of all at the last call."""
        for size in sorted(self.waiting, reverse=True):
            held = sorted(self.waiting[size], key=lambda x: -x[0])
            many = max(1, self.step_tokens // size)
            upto = len(held) if last else len(held) // many * many
            for at in range(0, upto, many):
                for _, pieces in held[at : min(at + many, upto)]:
                    offset = 0
                    for doc, start, n, crc, total, ids in pieces:
                        yield (doc, start, n, crc, total, self.next_sequence, offset, size, self.next_step) + (ids,)
                        offset += n
                    self.next_sequence += 1
                self.next_step += 1
            self.waiting[size] = held[upto:]


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset, context (size) and step; with_ids adds the ids."""
    with open(tokenizer, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step"]

    def run(batches):
        table = table_of(held.value)
        packer = Packer(TaskContext.get().partitionId() << LOCAL_BITS, tiers, step_tokens, with_ids)
        key_type = None

        def out(last: bool):
            packer.pack(last)
            made = list(packer.steps(last))
            for at in range(0, len(made), 10_000):
                columns = list(zip(*made[at : at + 10_000]))
                arrays = [pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:9]]]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(columns[9], pa.list_(pa.int32()))] if with_ids else []), [key, *names] + ["ids"] * with_ids)

        for batch in batches:
            key_type = batch.schema[0].type
            names_of = iter(batch.column(0).to_pylist())
            for group in in_groups(value.as_py() or "" for value in batch.column(1)):
                for ids in table.encode(group):
                    packer.add(next(names_of), np.append(ids, np.int32(end)))
                if packer.added >= BLOCK_TOKENS:
                    packer.added = 0
                    yield from out(False)
        if key_type is not None:
            yield from out(True)

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names)
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def table_of(file: bytes) -> WordTable:
    name = hash(file)
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = WordTable(ByteTokens(file, special=True))
    return _TABLES[name]


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per sequence: sequence_id, context, step, its ids and the documents they come from, from pieces with ids."""
    run = F.struct("offset", "ids", F.col(key).alias("doc"))
    grouped = pieces.groupBy("sequence_id", "context", "step").agg(F.array_sort(F.collect_list(run)).alias("p"))
    return grouped.select("sequence_id", "context", "step", F.flatten("p.ids").alias("ids"), F.col("p.doc").alias("docs"))
