"""URL verdicts: host and path rules, and for the rest naive Bayes over segmented host names and path words.

Host labels such as `dailynewsfeed` are split into words by a unigram Viterbi search; the unigrams are the words of all page
titles, of any length and number. They are counted as a table; the tasks hold only those that stand in some host, as no other can
be a piece of one, and the number of all. Multinomial naive Bayes is counted over all rule-judged URLs, with tokens hashed into
BUCKETS buckets, and scores the URLs without a rule.

Edge cases: a null URL, or one without `://`, has empty host and path and no rule; the method judges it by the prior. Without
any rule-judged URL the verdict is `allow`; so are ties. Repeated rows get equal results; all other columns pass unchanged.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabspark.llm.common import LOWER, UPPER, Scratch

BUCKETS = 1 << 16
VERDICTS = ("allow", "block")
_WORD = re.compile(r"[^\W_]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, (at + 3).cast("int"))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as host plus path, else null. A rule fits its host and subdomains."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


class Words:
    """Unigram counts and the Viterbi split of a name into words. total: of all words, if counts has not all of them."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.lengths = sorted({len(w) for w in counts})
        self.cost = {w: math.log(total) - math.log(n) for w, n in counts.items()}
        self.total = math.log(total)
        self.seen: dict[str, tuple[str, ...]] = {}

    def unknown(self, length: int) -> float:
        """Cost of a word that no title holds: each further letter makes it ten times less likely."""
        return self.total + (length - 1) * math.log(10)

    def split(self, name: str) -> tuple[str, ...]:
        if name in self.seen:
            return self.seen[name]
        best, back, begin = [0.0], [0], 0
        for end in range(1, len(name) + 1):
            # A further letter costs every unknown word the same: the best start of one stays the best, but for a new one.
            c, begin = min((best[a] + self.unknown(end - a), a) for a in (begin, end - 1))
            options = [(c, begin)]
            for length in self.lengths:
                if length > end:
                    break
                known = self.cost.get(name[end - length : end])
                if known is not None:
                    options.append((best[end - length] + known, end - length))
            c, a = min(options)
            best.append(c)
            back.append(a)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        if len(self.seen) > 100_000:
            self.seen.clear()
        self.seen[name] = tuple(reversed(out))
        return self.seen[name]

    def tokens(self, host: str, path: str) -> list[str]:
        """Marked tokens: words of the host's labels, and words of the path."""
        out = ["h:" + w for label in _WORD.findall(host) for w in self.split(label)]
        return out + ["p:" + w.lower() for w in _WORD.findall(path)]


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class UrlModel:
    words: Words
    weight: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))  # log odds of block per bucket
    prior: float = 0.0

    def score(self, host: str, path: str) -> float:
        """Log odds of block."""
        return self.prior + float(self.weight[[bucket(t) for t in self.words.tokens(host, path)]].sum())


def title_words(pages: DataFrame, page: str = "html", url: str = "url") -> Words:
    """Counts of the words of all page titles; the driver gets those that are part of a host, and the sum over all."""
    title = F.lower(F.regexp_extract(F.coalesce(F.col(page), F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    scratch = Scratch(pages.sparkSession, "title-words")
    counts = scratch.keep(words.groupBy("w").agg(F.count("*").alias("n")))
    total, longest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.length("w")), F.lit(0))).first()
    runs = pages.select(host_and_path(F.col(url))[0].alias("h")).distinct().select(F.explode(F.regexp_extract_all("h", F.lit(r"[\p{L}]+"), F.lit(0))).alias("r"))
    tails = F.transform(F.sequence(F.lit(1), F.length("r")), lambda i: F.substr(F.col("r"), i, F.lit(longest)))
    tails = runs.where("r <> ''").distinct().select(F.explode(tails).alias("t")).where("t <> ''").distinct()
    pieces = tails.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t")), lambda k: F.substr(F.col("t"), F.lit(1), k))).alias("w")).distinct()
    found = Words({r.w: r.n for r in counts.join(pieces, "w", "left_semi").collect()}, total)
    scratch.drop(counts)
    return found


def train(judged: DataFrame, words: Words) -> UrlModel:
    """Naive Bayes over rows (host, path, verdict) that have a verdict; the driver gets one row per bucket and verdict."""
    shared = judged.sparkSession.sparkContext.broadcast(words)

    def counted(frames):
        counts = np.zeros((len(VERDICTS), BUCKETS + 1), dtype=np.int64)
        for frame in frames:
            for host, path, verdict in zip(frame["host"], frame["path"], frame["verdict"]):
                row = counts[VERDICTS.index(verdict)]
                row[BUCKETS] += 1
                np.add.at(row, [bucket(t) for t in shared.value.tokens(host, path)], 1)
        k, at = np.nonzero(counts)
        yield pd.DataFrame({"k": k, "at": at, "n": counts[k, at]})

    rows = judged.where(F.col("verdict").isin(*VERDICTS)).select("host", "path", "verdict")
    table = rows.mapInPandas(counted, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(VERDICTS), BUCKETS + 1))
    if table.num_rows:
        counts[table.column("k").to_numpy(), table.column("at").to_numpy()] = table.column("n").to_numpy()
    urls, tokens = counts[:, BUCKETS], counts[:, :BUCKETS]
    if not urls.sum():
        return UrlModel(words)
    seen = tokens.sum(axis=0) > 0
    log_prob = np.log(tokens + 1.0) - np.log(tokens.sum(axis=1, keepdims=True) + max(int(seen.sum()), 1))
    # Tokens that no judged URL holds say nothing.
    return UrlModel(words, np.where(seen, log_prob[1] - log_prob[0], 0.0), float(np.log(urls[1] + 1.0) - np.log(urls[0] + 1.0)))


def judge(urls: DataFrame, model: UrlModel, into: str = "verdict") -> DataFrame:
    """All rows and columns of (host, path, rule, rule_verdict, ...), with the rule's verdict or else the method's."""
    shared = urls.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def scored(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(h, p) for h, p in zip(host, path)], dtype=float)

    score = scored("host", "path")
    return urls.withColumn("block_log_odds", score).withColumn(
        into, F.coalesce("rule_verdict", F.when(F.col("block_log_odds") > 0, "block").otherwise("allow"))
    )


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """All rows and columns, with host, path, the longest rule that fits and its verdict."""
    host, path = host_and_path(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    named = {h + p: v for v, h, p in rules}
    ruled = parsed.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, v in named.items():
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    return ruled.withColumn("rule_verdict", verdict)
