"""Ids of a byte-level BPE tokenizer file, segmented once per distinct marked word.

No token of such a tokenizer holds a space behind another character, so a text falls apart at every space that follows a
character which is not white space, and each part (a marked word) has the same ids wherever it stands. Many words are segmented
in one call: the vocabulary of the file serves as the rank table of a second library, after a check that its ids are in the
order of its merges. Words with letters beyond U+024F, words that end in white space and whole vocabularies that fail the check
go to the file's own library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: How byte-level tokenizers cut a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
JOINED = 20_000
#: Characters that are looked up in one go.
GROUP_CHARS = 2_000_000
#: Longer words are segmented by the file's own library, where they stand, and not kept.
LONG = 1_000
#: A space, and letters below U+0250 without white space at either end: both libraries know these alike, whatever their release of Unicode.
EASY = re.compile(r" [^\s\u0250-\U0010FFFF](?:[^\u0250-\U0010FFFF]{0,%d}[^\s\u0250-\U0010FFFF])?" % (LONG - 2))
BOUNDARY = re.compile(r"(?<=\S) ")
RUN = re.compile(r"\s ")


def marked_words(text: str) -> list[str]:
    """Parts of the text at spaces that follow a character other than white space; each part but the first had a space before it."""
    if RUN.search(text) is None and not text.startswith(" "):
        return text.split(" ")
    return BOUNDARY.split(text)


def byte_of_letter() -> dict[str, int]:
    """What byte each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others for 256 and up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """The tokenizer of a file; `special` says whether the special strings in a text are tokens or plain text."""

    def __init__(self, file: bytes, special: bool):
        self.library = Tokenizer.from_buffer(file)
        self.library.encode_special_tokens = not special
        described = json.loads(file)
        vocabulary, letters = described["model"]["vocab"], byte_of_letter()
        self.specials = [x["content"] for x in described["added_tokens"]] if special else []
        self.token = [b""] * (max(vocabulary.values()) + 1 + len(described["added_tokens"]))
        for name, i in vocabulary.items():
            self.token[i] = bytes(letters[x] for x in name) if all(x in letters for x in name) else name.encode()
        for x in described["added_tokens"]:
            self.token[x["id"]] = x["content"].encode()
        self.length = np.array([len(x) for x in self.token], np.int64)
        self.fast = None
        if self._merges_in_order(described):
            extra = {x["id"] for x in described["added_tokens"]}
            ranks = {self.token[i]: i for i in vocabulary.values() if i not in extra}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _merges_in_order(described: dict) -> bool:
        model, before = described["model"], described["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and described["normalizer"] is None
        if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return False
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        ids = [model["vocab"]["".join(x)] for x in pairs]
        return all(x in model["vocab"] for x in byte_of_letter()) and all(a < b for a, b in zip(ids, ids[1:])) and len(ids) + 256 == ids[-1] + 1

    def plain(self, text: str) -> bool:
        """Whether the marked words of the text can be segmented one by one."""
        return not any(x in text for x in self.specials)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after another, and the number of ids of each word."""
        counts = np.zeros(len(words), np.int64)
        easy = list(map(EASY.fullmatch, words)) if self.fast is not None else [None] * len(words)
        parts = [np.zeros(0, np.int32)]
        fast = [i for i, e in enumerate(easy) if e]
        for at in range(0, len(fast), JOINED):
            some = fast[at : at + JOINED]
            ids = np.array(self.fast.encode_ordinary("".join([words[i] for i in some])), np.int32)
            ends = np.cumsum([len(words[i].encode()) for i in some])
            token_ends = np.cumsum(self.length[ids])
            upto = np.searchsorted(token_ends, ends) + 1
            if not np.array_equal(token_ends[upto - 1], ends):
                raise ValueError("a token crosses the border of a marked word")
            counts[some] = np.diff(upto, prepend=0)
            parts.append(ids)
        slow = [i for i, e in enumerate(easy) if not e]
        listed = [x.ids for x in self.library.encode_batch_fast([words[i] for i in slow], add_special_tokens=False)] if slow else []
        quick = np.concatenate(parts)
        if not slow:
            return quick, counts
        counts[slow] = [len(x) for x in listed]
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        out[spread(starts[fast], counts[fast])] = quick
        for i, x in zip(slow, listed):
            out[starts[i] : starts[i] + len(x)] = x
        return out, counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (counts[i] of them) of all i in order."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(need, 2 * len(self.held)) - len(self.held), self.held.dtype)])
        self.held[self.n : need] = values
        self.n = need


def in_groups(texts: Iterable[str], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters."""
    group, n = [], 0
    for text in texts:
        group.append(text)
        n += len(text)
        if n >= chars:
            yield group
            group, n = [], 0
    if group:
        yield group


class WordTable:
    """Marked word -> its ids, for as long as the worker lives; at most MAX_WORDS words and then it starts anew."""

    MAX_WORDS = 900_000

    def __init__(self, tokens: ByteTokens):
        self.tokens = tokens
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.start, self.count = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def learn(self, new: list[str]) -> None:
        ids, counts = self.tokens.segment([" " + w for w in new])
        first = len(self.rows)
        self.rows.update(zip(new, range(first, first + len(new))))
        self.start.add(self.ids.n + np.cumsum(counts) - counts)
        self.count.add(counts)
        self.ids.add(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the first word of a text has no space before it and is segmented by itself."""
        if len(self.rows) > self.MAX_WORDS:
            self.clear()
        words = [marked_words(t) if self.tokens.plain(t) else None for t in texts]
        if any(w is None or max(map(len, w)) > LONG for w in words):
            direct = [None if w is not None and max(map(len, w)) <= LONG else self._direct(t, w) for t, w in zip(texts, words)]
            rest = iter(self.encode([t for t, d in zip(texts, direct) if d is None]))
            return [next(rest) if d is None else d for d in direct]
        head_ids, head_counts = self.tokens.segment([w[0] for w in words])
        heads = np.split(head_ids, np.cumsum(head_counts)[:-1])
        body = list(chain.from_iterable([w[1:] for w in words]))
        self.learn(list(set(body).difference(self.rows)))
        rows = np.fromiter(map(self.rows.__getitem__, body), np.int64, len(body))
        counts = self.count.held[rows]
        ids = self.ids.held[spread(self.start.held[rows], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(w) - 1 for w in words])] if words else np.zeros(0, np.int64)
        return [np.concatenate(x) for x in zip(heads, np.split(ids, upto[:-1]))]

    def _direct(self, text: str, words: list[str] | None) -> np.ndarray:
        """Ids of a text with special strings or with long words, which are not kept."""
        if words is None:
            return self.tokens.whole(text)
        return self.tokens.segment([words[0], *[" " + w for w in words[1:]]])[0]
