"""Personal data in texts: fixed patterns, and a skip-chain conditional random field that adds spans.

The patterns give the base spans (`base_spans`). Further candidates - number runs and words with an at sign that no base span
touches - are nodes of a random field next to the base spans, whose labels are observed. Neighbouring nodes share chain
potentials; all nodes with the same or a similar token (same digits, same last seven digits, same address) are joined to one
hidden node of their own, so the number of edges is linear and any two repeats are two steps apart. Loopy sum-product passing,
until the messages settle, gives every candidate a distribution over {none, email, ip, card, phone}; a candidate whose best kind
is at least THRESHOLD sure becomes a span.
Weights are fitted by pseudo-likelihood (each label given the shown labels around it) on a sample of about SAMPLE_DOCS texts,
chosen by key hash. In each text half of the base spans are hidden at random: they and the free candidates are the examples. What
a repeat in another form looks like is shown by every base span itself, with its form taken away (bare digits, or an address
without its domain; forms that the patterns find by themselves are left out): next to the shown span it has the span's kind,
and alone it has none. Same or similar candidates share one potential, so that many repeats do not outvote the span they repeat.
Free candidates that share a token with a base span have no known label and are no examples. Every text is then searched whole.

Edge cases: a null or empty text has no spans. Without anything to learn from, no spans are added. Spans are code points, end
exclusive. Repeated rows get equal results; all other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is none
SAMPLE_DOCS = 4_000
THRESHOLD = 0.9
SETTLED = 1e-4
SMALLEST_STEP = 1e-3
STEPS, PENALTY = 3_000, 1e-4  # of the fit
ROUNDS = 100  # rounds after which the step of the messages is halved, so that they settle on loops too
NEAR = 40

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_WORD_AT = re.compile(r"[A-Za-z0-9-]++")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _at_signs(text: str, floor_of_domain: bool):
    """Address candidates around each at sign: start, end; with a dotted domain or a plain word after the sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = (_DOMAIN if floor_of_domain else _WORD_AT).match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as listed and then by start."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _at_signs(text, True)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- the random field --------------------------------------------------------
SIZES = (7, 9, 10, 11, 12, 13, 15, 16, 17, 20)
FEATURES = 1 + len(SIZES) + 1 + 12


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that hold: size, separators, at sign, dots, and what stands next to the token."""
    token, before, after = text[start:end], text[start - 1 : start], text[end : end + 1]
    digits = sum(c.isdigit() for c in token)
    out = [0, 1 + bisect_left(SIZES, digits)]
    at = 2 + len(SIZES)
    shape = ("@" in token, token.count(".") == 3, "." in token, "-" in token, " " in token, "(" in token, digits * 2 < len(token), len(token) > 30)
    beside = (before.isalnum(), after.isalnum(), before in "\"'=" and before != "", before == ":")
    return out + [at + i for i, holds in enumerate(shape + beside) if holds]


def keys(text: str, start: int, end: int) -> list[str]:
    """What same or similar tokens have in common."""
    token = text[start:end]
    if "@" in token:
        return ["@" + token.lower(), "@" + token.lower().partition("@")[0]]
    digits = _NOT_DIGIT.sub("", token)
    return [digits, "~" + digits[-7:]] if len(digits) >= 7 else [digits]


def nodes(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the nodes (start, end, observed label or -1) in text order."""
    if not text or ("@" not in text and not _DIGIT.search(text)):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    free = []

    def untouched(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or reach[i - 1] <= a

    if "@" in text:
        free += [(a, b) for a, b in _at_signs(text, False) if untouched(a, b)]
    held = sorted(free)
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        if b - a >= 7 and len(_NOT_DIGIT.sub("", m.group())) >= 7 and untouched(a, b):
            i = bisect_left(held, (b, 0))
            if i == 0 or held[i - 1][1] <= a:
                free.append((a, b))
    return base, sorted([(a, b, k + 1) for k, a, b in base] + [(a, b, -1) for a, b in free])


def edges(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Chain edges between close neighbours, and the groups of nodes with the same or a similar token, each group once."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= NEAR]
    held: dict[str, list[int]] = {}
    for i, (a, b, _) in enumerate(found):
        for k in keys(text, a, b):
            held.setdefault(k, []).append(i)
    return chain, sorted({tuple(x) for x in held.values() if len(x) > 1})


def spoke(weight: float) -> float:
    """Weight of the edges to a hidden node that gives two nodes joined to it alone the pair potential exp(weight)."""
    w = np.exp(weight)
    return float(np.log(w + np.sqrt(w * w + (LABELS - 2) * w - (LABELS - 1))))


def propagate(unary: np.ndarray, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Marginals by loopy sum-product with potentials exp(weight) for equal labels; unary holds log potentials."""
    if not len(pairs):
        belief = unary
    else:
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        n = len(pairs)
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        gain = np.expm1(np.concatenate([weights, weights]))[:, None]
        message = np.zeros((2 * n, LABELS))
        step, rounds = 0.5, 0
        while True:
            belief = unary.copy()
            np.add.at(belief, target, message)
            into = belief[source] - message[back]
            into = np.exp(into - into.max(axis=1, keepdims=True))
            new = np.log(into.sum(axis=1, keepdims=True) + gain * into)
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = (1 - step) * message + step * new
            rounds += 1
            if moved < SETTLED or step < SMALLEST_STEP:
                break
            if rounds % ROUNDS == 0:
                step /= 2
        belief = unary.copy()
        np.add.at(belief, target, message)
    out = np.exp(belief - belief.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


class SkipChain:
    """Weights: features x labels, and one for equal labels on chain edges and of two nodes of one group."""

    def __init__(self, table: np.ndarray, chain: float, skip: float):
        self.table, self.chain, self.skip = table, chain, skip

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and added spans."""
        base, found = nodes(text)
        if not any(x[2] < 0 for x in found):
            return base, []
        unary = np.full((len(found), LABELS), -50.0)
        free: dict[str, list[int]] = {}
        for i, (a, b, label) in enumerate(found):
            if label < 0:
                unary[i] = self.table[features(text, a, b)].sum(axis=0)
                free.setdefault(keys(text, a, b)[-1], []).append(i)
            else:
                unary[i, label] = 0.0
        # Same or similar tokens share one potential: what speaks against a number counts once, however often it stands there.
        for group in free.values():
            unary[group] = unary[group].mean(axis=0) / len(group)
        chain, groups = edges(text, found)
        star = [(i, len(found) + k) for k, group in enumerate(groups) for i in group]
        unary = np.concatenate([unary, np.zeros((len(groups), LABELS))])
        weights = np.array([self.chain] * len(chain) + [spoke(self.skip)] * len(star))
        marginal = propagate(unary, np.array(chain + star, dtype=np.int64).reshape(-1, 2), weights)[: len(found)]
        best = marginal.argmax(axis=1)
        return base, [(int(best[i]) - 1, a, b) for i, (a, b, label) in enumerate(found) if label < 0 and best[i] > 0 and marginal[i, best[i]] >= THRESHOLD]


def bare_forms(kind: int, token: str) -> list[str]:
    """The token as it may be repeated elsewhere: without separators, without the domain's ending, without the country's digits."""
    if kind == 0:
        return [token.partition("@")[0] + "@" + _WORD_AT.match(token, token.index("@") + 1).group()]
    digits = _NOT_DIGIT.sub("", token)
    return sorted({digits, digits[-10:], digits[-7:]}) if kind == 3 else [digits]


def examples(text: str | None):
    """(features, shown labels of the chain, shown labels of the groups, label) of the nodes of a text whose label is known."""
    _, found = nodes(text)
    if not found:
        return
    chain, groups = edges(text, found)
    hide = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass"))).random(len(found)) < 0.5
    shown = [0 if label < 0 or hidden else label for (_, _, label), hidden in zip(found, hide)]
    beside: dict[int, list[int]] = {}
    for i, j in chain:
        beside.setdefault(i, []).append(shown[j])
        beside.setdefault(j, []).append(shown[i])
    alike: dict[int, list[int]] = {}
    unknown = set()
    for group in groups:
        labels = Counter(shown[i] for i in group)
        held = any(found[i][2] > 0 for i in group)
        for i in group:
            alike.setdefault(i, []).extend(k for k in labels if k > 0 and labels[k] > (shown[i] == k))
            if held and found[i][2] < 0:
                unknown.add(i)
    for i, (a, b, label) in enumerate(found):
        if i not in unknown and not shown[i]:
            yield features(text, a, b), sorted(k for k in beside.get(i, ()) if k), sorted(alike.get(i, ())), max(label, 0)
        if label > 0:
            for form in bare_forms(label - 1, text[a:b]):
                if not base_spans(form):
                    seen = features(f" {form} ", 1, 1 + len(form))
                    yield seen, [], [label], label
                    yield seen, [], [], 0


def fit_weights(rows: list[tuple[str, str, str, int, int]]) -> SkipChain:
    """Weights of largest pseudo-likelihood with a small penalty; both edge weights are at least 0. Lists are comma-joined."""
    if not rows:
        return SkipChain(np.zeros((FEATURES, LABELS)) + np.array([1.0, 0, 0, 0, 0]) * 50, 0.0, 0.0)
    rows = sorted(rows)
    x, near = np.zeros((len(rows), FEATURES)), np.zeros((2, len(rows), LABELS))
    for i, (at, *around, _, _) in enumerate(rows):
        x[i, [int(j) for j in at.split(",")]] = 1
        for part, listed in zip(near, around):
            for k in filter(None, listed.split(",")):
                part[i, int(k)] += 1
    y, n = np.eye(LABELS)[[r[3] for r in rows]], np.array([r[4] for r in rows], dtype=float)
    n /= n.sum()
    w, e = np.zeros((FEATURES, LABELS)), np.zeros(2)
    ahead_w, ahead_e, pace = w, e, 1.0
    rate = 2 / (n @ ((x**2).sum(axis=1) + (near**2).sum(axis=(0, 2))))
    for _ in range(STEPS):
        p = x @ ahead_w + np.tensordot(ahead_e, near, 1)
        p = np.exp(p - p.max(axis=1, keepdims=True))
        slope = (p / p.sum(axis=1, keepdims=True) - y) * n[:, None]
        new_w = ahead_w - rate * (x.T @ slope + PENALTY * ahead_w)
        new_e = np.maximum(ahead_e - rate * ((near * slope).sum(axis=(1, 2)) + PENALTY * ahead_e), 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead_w, ahead_e = new_w + (pace - 1) / faster * (new_w - w), new_e + (pace - 1) / faster * (new_e - e)
        w, e, pace = new_w, new_e, faster
    return SkipChain(w, float(e[0]), float(e[1]))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> SkipChain:
    """Weights from a sample of about SAMPLE_DOCS texts; the examples are made by the tasks, the driver gets counts of them."""
    total = docs.count()
    cut = int(min(1.0, SAMPLE_DOCS / max(total, 1)) * (1 << 30))

    def seen(batches):
        for frame in batches:
            rows = Counter()
            for value in frame["t"]:
                rows.update((*(",".join(map(str, part)) for part in parts), label) for *parts, label in examples(value))
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["at", "chain", "alike", "label", "n"])

    sample = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < cut).select(F.col(text).alias("t"))
    rows = sample.mapInPandas(seen, "at string, chain string, alike string, label int, n long").groupBy("at", "chain", "alike", "label").agg(F.sum("n").alias("n"))
    return fit_weights([tuple(r) for r in rows.collect()])


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame, model: SkipChain, text: str = "text", into: str = "pii") -> DataFrame:
    """All rows and columns, with a struct of the counts of base spans by kind, their digest, all spans and the number added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def judged(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            base, added = shared.value.spans(v)
            n = [0, 0, 0, 0]
            for k, _, _ in base:
                n[k] += 1
            out.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added), len(added)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.withColumn(into, judged(F.col(text)))
