"""Alignment of the tokens of two tokenizers over the same text, and how often their ids are linked in a corpus.

The byte offsets where tokens of either tokenizer end are two rising lists. A galloping intersection finds the common offsets: the
shorter list drives, and each of its ends is looked for in the longer one by doubling steps from the place reached, then by
bisection. Common offsets cut both lists into groups. The tokens of B that a token of A overlaps are a range of ranks: from the
number of ends of B up to where the token begins to the number of ends before it ends.

Neither tokenizer has a token that holds a space behind another character, so tokens of a text are those of its marked words
(parts at spaces behind a character that is not white space), and every border of such words is a common offset. Each distinct
word is segmented and aligned once per worker (a table of MAX_WORDS words, then it starts anew) and texts take the results by
position. A vocabulary of B that crosses markers is refused.

How often two ids are linked is counted over all texts first (words times their links, summed in each task, then by Spark); every
link then looks up its count. The counted pairs are broadcast in parts of at most PART_PAIRS pairs (about; a part ends with an id of B),
so the size of what is broadcast does not depend on the corpus; more parts mean more passes.

Edge cases: null and empty texts, and texts that the bytes of either tokenizer's tokens do not give back with one space before them
(as texts that hold the marker itself), have no tokens: zeros and an empty digest. Texts of any length are aligned whole. Repeated rows get
equal results and count each. Of other columns nothing is read. In an empty table no pair is counted.
"""

from __future__ import annotations

import gc
import hashlib
from bisect import bisect_left
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.byte_tokens import LONG, ByteTokens, Grown, in_groups, marked_words, spread
from tabspark.llm.common import Scratch
from tabspark.llm.pieces import MARK

MAX_WORDS = 900_000
PART_PAIRS = 1_000_000
#: Occurrences looked at before they are added up.
COUNTED = 2_000_000
#: A pair of ids as one number: the id of B above, that of A in the low bits.
A_BITS = 32
_TABLES: dict[tuple[int, int], "AlignedWords"] = {}


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Indices in both rising lists of the values that stand in both, by galloping through the longer one."""
    if len(a) > len(b):
        y, x = common_ends(b, a)
        return x, y
    x, y, at, n = [], [], 0, len(b)
    put_x, put_y = x.append, y.append
    for i, end in enumerate(a):
        if at == n:
            break
        value = b[at]
        if value < end:
            step, low = 1, at
            while at < n and b[at] < end:
                low = at + 1
                at += step
                step *= 2
            if low != at:
                at = bisect_left(b, end, low, min(at, n))
            if at == n:
                break
            value = b[at]
        if value == end:
            put_x(i)
            put_y(at)
            at += 1
    return x, y


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of B that each token of A overlaps, and how many it overlaps, from differences of ranks."""
    starts = np.concatenate([[0], a_ends[:-1]])
    first = np.searchsorted(b_ends, starts, side="right")
    return first, np.searchsorted(b_ends, a_ends, side="left") - first + 1


class AlignedWords:
    """Marked word -> its groups and links, for as long as the worker lives."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a = ByteTokens(a_file, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in x.lstrip(MARK) for x in names) or self.b.encode("a b") != self.b.encode("a") + self.b.encode("b"):
            raise ValueError("pieces of this model cross whitespace markers")
        self.b_token = [bytes([int(x[1:-1], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        self.b_length = np.array([len(x) for x in self.b_token], np.int64)
        self.shown = [str(i) for i in range(max(len(self.a.token), len(names)))]
        self.version = 0
        self.clear()

    def clear(self) -> None:
        self.version += 1
        self.rows: dict[str, int] = {}
        self.groups: list[str | None] = []  # None where the bytes differ
        self.long = False
        self.n_a, self.n_b, self.n_groups, self.n_links = (Grown(np.int64) for _ in range(4))
        self.first_link, self.links = Grown(np.int64), Grown(np.int64)

    def _segment_b(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of B, one after another, and the number of each word's."""
        lists = [x if w else [self.b.piece_to_id(MARK)] for w, x in zip(words, self.b.encode(words, num_threads=1))] if words else []
        return np.array(list(chain.from_iterable(lists)), np.int64), np.array([len(x) for x in lists], np.int64)

    def _align_apart(self, words: list[str], b_ids: np.ndarray, n_b: np.ndarray):
        """align() where some words' bytes differ: these have no tokens."""
        own = np.split(b_ids, np.cumsum(n_b)[:-1])
        good = [i for i, w in enumerate(words) if b"".join([self.b_token[k] for k in own[i].tolist()]) == b" " + w.encode()]
        text, *counts, links = self.align([words[i] for i in good])
        out: list[str | None] = [None] * len(words)
        wide = [np.zeros(len(words), np.int64) for _ in counts]
        for at, i in enumerate(good):
            out[i] = text[at]
        for w, c in zip(wide, counts):
            w[good] = c
        return out, *wide, links

    def align(self, words: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word (the space before it left out): groups as text, numbers of tokens, groups and links; and all links."""
        a_ids, n_a = self.a.segment([" " + w for w in words])
        b_ids, n_b = self._segment_b(words)
        # What the bytes of B do not give back takes no part.
        if b"".join(map(self.b_token.__getitem__, b_ids.tolist())) != "".join([" " + w for w in words]).encode():
            return self._align_apart(words, b_ids, n_b)
        a_ends, b_ends = np.cumsum(self.a.length[a_ids]), np.cumsum(self.b_length[b_ids])
        x, y = common_ends(a_ends.tolist(), b_ends.tolist())
        # Groups lie inside words: every word ends at a common offset.
        a_upto = np.cumsum(n_a)
        x, y = np.array(x, np.int64), np.array(y, np.int64)
        n_groups = np.diff(np.searchsorted(x, a_upto - 1) + 1, prepend=0)
        i, j = np.concatenate([[0], x[:-1] + 1]), np.concatenate([[0], y[:-1] + 1])
        shown = np.empty(len(x), object)
        # Most groups are one token of each; their texts are few.
        single = np.flatnonzero((i == x) & (j == y)) if len(x) else x
        pairs, place = np.unique((a_ids[x[single]].astype(np.int64) << A_BITS) | b_ids[y[single]], return_inverse=True)
        low = (1 << A_BITS) - 1
        shown[single] = np.array([f"{k >> A_BITS}|{k & low}" for k in pairs.tolist()], object)[place] if len(single) else []
        text_of = self.shown
        wide = np.setdiff1d(np.arange(len(x)), single, assume_unique=True)
        a_list, b_list = a_ids.tolist(), b_ids.tolist()
        for g, a0, a1, b0, b1 in zip(wide.tolist(), i[wide].tolist(), (x[wide] + 1).tolist(), j[wide].tolist(), (y[wide] + 1).tolist()):
            shown[g] = ",".join([text_of[k] for k in a_list[a0:a1]]) + "|" + ",".join([text_of[k] for k in b_list[b0:b1]])
        shown = shown.tolist()
        ends = list(accumulate(n_groups.tolist()))
        text = [";".join(shown[e - n : e]) if n > 1 else shown[e - 1] for e, n in zip(ends, n_groups.tolist())]
        first, many = overlaps(a_ends, b_ends) if len(a_ids) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        links = (b_ids[spread(first, many)] << A_BITS) | np.repeat(a_ids.astype(np.int64), many)
        n_links = np.add.reduceat(many, a_upto - n_a) if len(words) else np.zeros(0, np.int64)
        return text, n_a, n_b, n_groups, n_links, links

    def learn(self, new: list[str]) -> None:
        gc.disable()  # nothing made here is cyclic, and there is much of it
        try:
            text, n_a, n_b, n_groups, n_links, links = self.align(new)
        finally:
            gc.enable()
        first = len(self.rows)
        self.rows.update(zip(new, range(first, first + len(new))))
        self.groups.extend(text)
        self.first_link.add(self.links.n + np.cumsum(n_links) - n_links)
        for held, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links), (self.links, links)):
            held.add(values)

    def find(self, texts: list[str]) -> list[np.ndarray | None]:
        """Rows of the words of each text; None if it has no tokens. The table starts anew first if it is full."""
        if self.full:
            self.clear()
        words = [marked_words(t) if t and MARK not in t else [] for t in texts]
        body = list(chain.from_iterable(words))
        new = list(set(body).difference(self.rows))
        self.learn(new)
        self.long = max(map(len, new), default=0) > LONG
        rows = np.fromiter(map(self.rows.__getitem__, body), np.int64, len(body))
        out = np.split(rows, np.cumsum([len(w) for w in words])[:-1])
        return [x if len(x) and self.n_a.held[x].all() else None for x in out]

    @property
    def full(self) -> bool:
        """Whether the next call starts the table anew."""
        return self.long or len(self.rows) > MAX_WORDS


def table_of(files: tuple[bytes, bytes]) -> AlignedWords:
    name = (hash(files[0]), hash(files[1]))
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = AlignedWords(*files)
    return _TABLES[name]


def _shared(df: DataFrame, *paths: str):
    held = []
    for path in paths:
        with open(path, "rb") as file:
            held.append(file.read())
    return df.sparkSession.sparkContext.broadcast(tuple(held))


def count_links(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> DataFrame:
    """(b, a, n): how many links of all texts hold the two ids."""
    files = _shared(docs, a_file, b_file)

    def run(batches):
        table = table_of(files.value)
        times, seen, n = np.zeros(0, np.int64), [], 0

        def summed() -> np.ndarray:
            """How often each word of the table was seen."""
            out = np.bincount(np.concatenate(seen), minlength=len(table.rows)) if seen else np.zeros(len(table.rows), np.int64)
            out[: len(times)] += times
            return out

        def counted() -> pa.RecordBatch:
            """The links of the words, each as often as its word was seen."""
            times = summed()
            at = np.flatnonzero(times)
            many = table.n_links.held[at]
            keys, place = np.unique(table.links.held[spread(table.first_link.held[at], many)], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, np.repeat(times[at], many))
            low = np.int64((1 << A_BITS) - 1)
            return pa.RecordBatch.from_arrays([pa.array((keys >> A_BITS).astype(np.int32)), pa.array((keys & low).astype(np.int32)), pa.array(sums)], ["b", "a", "n"])

        for batch in batches:
            for group in in_groups(value.as_py() or "" for value in batch.column(0)):
                if table.full:
                    yield counted()
                    times, seen, n = np.zeros(0, np.int64), [], 0
                for rows in table.find(group):
                    if rows is not None:
                        seen.append(rows)
                        n += len(rows)
                if n > COUNTED:
                    times, seen, n = summed(), [], 0
        yield counted()

    return docs.select(text).mapInArrow(run, "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))


class LinkScores:
    """Sums of the counts of each word's links, and how many of them are the most frequent of their id of B, for one part of the pairs."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.keys, self.n, self.best = pairs
        self.version = None

    def follow(self, table: AlignedWords) -> None:
        """Add what the table has learnt since."""
        if self.version != table.version:
            self.version, self.sum, self.most = table.version, Grown(np.int64), Grown(np.int64)
        if self.sum.n == len(table.rows):
            return
        links = table.links.held[table.first_link.held[self.sum.n] : table.links.n]
        at = np.minimum(np.searchsorted(self.keys, links), max(0, len(self.keys) - 1))
        found = self.keys[at] == links if len(self.keys) else np.zeros(len(links), bool)
        ends = np.cumsum(table.n_links.held[self.sum.n : len(table.rows)])
        for held, values in ((self.sum, np.where(found, self.n[at], 0) if len(self.n) else found), (self.most, found & self.best[at] if len(self.n) else found)):
            held.add(np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])]))


def _parts(pairs: DataFrame) -> list[tuple[int, int]]:
    """Ranges of ids of B that hold about PART_PAIRS pairs each; the ids are as many as the vocabulary has, whatever the corpus."""
    out, held = [], 0
    for b, n in sorted(map(tuple, pairs.groupBy("b").count().collect())):
        if not out or held + n > PART_PAIRS:
            out.append((b, b))
            held = 0
        held += n
        out[-1] = (out[-1][0], b)
    return out or [(0, 0)]


def _part(pairs: DataFrame, low: int, high: int):
    """The pairs of a range, in order, with their counts and whether no pair of their id of B counts more; broadcast."""
    rows = pairs.where(F.col("b").between(low, high)).toArrow()
    b, a, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("b", "a", "n"))
    keys = (b << A_BITS) | a
    order = np.argsort(keys)
    keys, n, b = keys[order], n[order], b[order]
    top = np.maximum.reduceat(n, np.flatnonzero(np.diff(b, prepend=-1))) if len(n) else n
    best = n == np.repeat(top, np.diff(np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b)))) if len(n) else n.astype(bool)
    return pairs.sparkSession.sparkContext.broadcast((keys, n, best))


def align(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per text: the key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with_groups adds the groups as text."""
    scratch = Scratch(docs.sparkSession, "alignment")
    files = _shared(docs, a_file, b_file)
    pairs = scratch.keep(count_links(docs, a_file, b_file, text))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def judged(rows: DataFrame, part, last: bool) -> DataFrame:
        """Adds a part's sums to n_best and count_sum; the last part gives all columns, the others pass the text on."""

        def run(batches):
            table, scores = table_of(files.value), LinkScores(part.value)
            for batch in batches:
                out, groups = [], []
                before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                for group in in_groups(value.as_py() or "" for value in batch.column(1)):
                    found = table.find(group)
                    scores.follow(table)
                    held = (table.n_a, table.n_b, table.n_groups, table.n_links, scores.most, scores.sum)
                    for at in found:
                        most, total = next(before)
                        if at is None:
                            out.append((0, 0, 0, 0, 0, 0))
                            groups.append("")
                            continue
                        whole = [int(x.held[at].sum()) for x in held]
                        out.append((*whole[:4], whole[4] + most, whole[5] + total))
                        if last:
                            groups.append(";".join([table.groups[i] for i in at.tolist()]))
                columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(numbers)
                if last:
                    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                    arrays = [batch.column(0), *columns, pa.array(digests, pa.string())] + ([pa.array(groups, pa.string())] if with_groups else [])
                    yield pa.RecordBatch.from_arrays(arrays, [key, *numbers, "groups_sha256"] + ["groups"] * with_groups)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns[4:]], [key, text, *numbers[4:]])

        schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, "
        if last:
            return rows.mapInArrow(run, schema + ", ".join(f"{n} long" for n in numbers) + ", groups_sha256 string" + ", groups string" * with_groups)
        return scratch.keep(rows.mapInArrow(run, schema + f"`{text}` string, n_best long, count_sum long"))

    rows = docs.select(F.col(key), F.col(text), F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    parts = _parts(pairs)
    for i, (low, high) in enumerate(parts):
        rows = judged(rows, _part(pairs, low, high), i == len(parts) - 1)
    return rows
