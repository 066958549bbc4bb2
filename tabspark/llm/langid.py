"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every training text, map-side, into a fixed number of buckets; the matrix of log
probabilities (buckets x languages, so of bounded size) goes to the tasks, which score texts with numpy.

Edge cases: a null or empty text, or one without any letter, is `und` with score 0. Rows without text or language are not
learned from. With nothing to learn from every text is `und`. Ties go to the language that sorts first. Texts of any length
are read whole, in blocks. Repeated rows and rows with null keys are judged one by one; all other columns pass unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BUCKETS = 1 << 16
SMOOTHING = 0.1
BLOCK = 1 << 18
UNKNOWN = "und"
RESULT = "lang_pred string, score double"
#: The matrix is broadcast: 4 bytes for each bucket and language, 64 MB at this bound.
MAX_LANGUAGES = 256
HELD_PER_TASK = 64


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> itself for letters, 0 for the rest."""
    out = np.zeros(0x110000, dtype=np.uint32)
    at = [i for i in range(0x110000) if chr(i).isalpha()]
    out[at] = at
    return out


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, every run of other characters as one 0, with a 0 at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = np.zeros(len(raw) + 2, dtype=np.uint32)
    x[1:-1] = letter_table()[raw]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    return x[keep]


def buckets(text: str):
    """Bucket numbers of all 1-, 2- and 3-grams, block by block."""
    x = letters(text)
    if not x.any():
        return
    m1, m2, m3 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK + 2]
        one = (part + np.uint32(1)) * m1
        two = (one[:-1] ^ (part[1:] * m2 + np.uint32(7))) * m3 if len(part) > 1 else one[:0]
        three = (two[:-1] ^ (part[2:] * m2 + np.uint32(13))) * m1 if len(part) > 2 else one[:0]
        for grams in (one[:BLOCK], two[:BLOCK], three[:BLOCK]):
            yield ((grams ^ (grams >> np.uint32(15))) * m3) >> np.uint32(16)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        total, seen = self.log_prior.copy(), False
        for at in buckets(text):
            seen = True
            total += np.bincount(at, minlength=BUCKETS) @ self.log_prob if len(at) > BUCKETS else self.log_prob[at].sum(axis=0, dtype=np.float64)
        if not seen:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Language, bucket and n-gram count over all rows; bucket -1 counts the texts."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at - 1, pa.int64()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"]
                )
            held.clear()

        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = held.get(name)
                if counts is None:
                    if len(held) >= HELD_PER_TASK:
                        yield from flush()
                    counts = held[name] = np.zeros(BUCKETS + 1, dtype=np.int64)
                counts[0] += 1
                for at in buckets(value):
                    counts[1:] += np.bincount(at, minlength=BUCKETS)
        yield from flush()

    rows = docs.select(F.col(text), F.col(lang)).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Model from all rows that have a text and a language. Languages beyond MAX_LANGUAGES are an error, not a cut."""
    table = count_grams(docs, text, lang)
    got = table.toArrow()
    found = np.array(got.column("lang").to_pylist(), dtype=object)
    names = sorted(set(found.tolist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the matrix is broadcast for at most {MAX_LANGUAGES}")
    at, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    counts = np.zeros((BUCKETS, len(names)))
    texts = np.zeros(len(names))
    for k, name in enumerate(names):
        mine = found == name
        grams = mine & (at >= 0)
        counts[at[grams], k] = n[grams]
        texts[k] = n[mine & (at < 0)].sum()
    log_prob = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BUCKETS)
    return LanguageModel(names, log_prob.astype(np.float32), np.log(texts / max(texts.sum(), 1)) if names else texts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """All rows and columns, with a struct (lang_pred, score) named by `into`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(RESULT)
    def judged(values: pd.Series) -> pd.DataFrame:
        out = [shared.value.judge(v) for v in values]
        return pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out]})

    return docs.withColumn(into, judged(F.col(text)))


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text leaves remainder 2 modulo 4; a row without key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
