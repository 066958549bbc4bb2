"""Helpers of the corpus operators: row keys, null-safe joins, scratch tables and byte-window hashes."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tabspark.staging import shared_dir, ship  # noqa: F401

#: Code points of A-Z and a-z, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables written below spark.checkpoint.dir by one call, so that a lost executor costs no recomputation.

    Tables that later steps no longer read are dropped with drop(); what is left belongs to the owner of the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.tables}"
        self.tables += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table of this scratch folder that nothing reads any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- byte windows ------------------------------------------------------------
#: Odd base of the byte polynomial and its inverse modulo 2**64 (fixed values).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Positions handled at once; long texts are cut into blocks of this many bytes with overlap.
BLOCK = 1 << 18


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the 64-bit values over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class ByteHash:
    """Hashes of any byte ranges of one block of at most 4 * BLOCK bytes, from running sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        size = 1 << max(10, int(n + 1).bit_length())
        self.inverse = powers(INVERSE, size)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte_values()[data] * powers(BASE, size)[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal bytes [start, end) and, mixed with the length, different for others but for chance."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + end.astype(np.uint64) - start.astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hash of every window of the length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)
