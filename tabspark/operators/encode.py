"""A frozen row encoder fitted on training rows: truncated SVD of hashed column=value rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabspark import spec
from tabspark.functions.text import quoted
from tabspark.operators.boost import JointTrees, Model
from tabspark.staging import discard, ship, staged

# Trees over the encoder's output.
ENCODED_TREES = {"maxIter": 200, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "columnShare": 0.8, "seed": spec.SEED}


class RowEncoder:
    """Hashes every row to `width` numbers and projects it on the `size` strongest right singular vectors of the training rows.

    Text columns and those named in `categorical` are hashed as column=value, other columns by name with their number as value; numbers
    are divided by their root mean square over the training rows first, so that no unit of measure decides the directions.
    The singular vectors are those of the Gram matrix of the hashed rows, summed over all training rows: its size is that of the
    hashed width, whatever the number of rows. After fit nothing changes; rows to encode are read only.

    Missing values add nothing to a row. Directions without any weight in the training rows are left out, so there may be fewer
    than `size` columns; without rows there are none. Each direction's largest component is positive.
    """

    def __init__(self, features: Sequence[str], size: int = 16, width: int = 256, categorical: Sequence[str] = ()):
        self.features, self.size, self.width, self.categorical = list(features), size, width, list(categorical)
        self.directions: np.ndarray | None = None
        self.scale: dict[str, float] = {}

    def _numbers(self, df: DataFrame) -> list[str]:
        kinds = dict(df.dtypes)
        return [c for c in self.features if c not in self.categorical and kinds[c] not in ("string", "boolean")]

    def hashed(self, df: DataFrame, into: str = "hashed") -> DataFrame:
        """All columns, with the hashed row as an array of doubles."""
        named = {c: f"__{i}" for i, c in enumerate(self.features)}
        scaled = [(quoted(c).cast("double") / self.scale[c] if c in self.scale else quoted(c)).alias(n) for c, n in named.items()]
        hasher = FeatureHasher(inputCols=list(named.values()), outputCol="__v", numFeatures=self.width, categoricalCols=[named[c] for c in self.categorical])
        out = hasher.transform(df.select("*", *scaled))
        return out.withColumn(into, vector_to_array("__v")).drop("__v", *named.values())

    def fit(self, train: DataFrame) -> RowEncoder:
        """Action: one pass for the scales, one for the Gram matrix."""
        ship(train.sparkSession)
        numbers = self._numbers(train)
        if numbers:
            squares = train.agg(*[F.sqrt(F.avg(quoted(c).cast("double") ** 2)).alias(c) for c in numbers]).first()
            self.scale = {c: float(squares[c]) or 1.0 if squares[c] is not None else 1.0 for c in numbers}
        width = self.width

        def gram(batches):
            total = np.zeros((width, width))
            for batch in batches:
                x = np.asarray(batch.column(0).values).reshape(batch.num_rows, width)
                total += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

        # One row of the matrix per task and place; their sums are as many numbers as the matrix has.
        parts = self.hashed(train).select("hashed").mapInArrow(gram, "i long, row array<double>")
        cells = parts.select("i", F.posexplode("row").alias("j", "x")).where("x <> 0").groupBy("i", "j").agg(F.sum("x").alias("x"))
        matrix = np.zeros((width, width))
        for r in cells.collect():
            matrix[r["i"], r["j"]] = r["x"]
        values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
        strongest = [k for k in np.argsort(-values, kind="stable")[: self.size] if values[k] > 1e-9 * max(values.max(), 1e-300)]
        directions = vectors[:, strongest].T
        top = directions[np.arange(len(directions)), np.abs(directions).argmax(axis=1)] if len(directions) else np.zeros(0)
        self.directions = directions * np.where(top < 0, -1.0, 1.0)[:, None]
        return self

    @property
    def names(self) -> list[str]:
        if self.directions is None:
            raise RuntimeError("call fit first")
        return [f"encoded_{i}" for i in range(len(self.directions))]

    def transform(self, df: DataFrame) -> DataFrame:
        """All columns, with the projections as encoded_0, encoded_1, ..."""
        names, directions = self.names, self.directions

        @pandas_udf("array<double>")
        def projected(rows):
            import pandas as pd

            return pd.Series(list(np.stack(rows.to_list()) @ directions.T)) if len(rows) else pd.Series([], dtype=object)

        out = self.hashed(df, "__hashed").withColumn("__encoded", projected("__hashed"))
        return out.select(*[quoted(c) for c in df.columns], *[F.element_at("__encoded", i + 1).alias(n) for i, n in enumerate(names)])


class EncodedTrees:
    """The frozen encoder, then boosted trees over what it returns; both see training rows only."""

    def __init__(self, features: Sequence[str], target: str, size: int = 16, width: int = 256, categorical: Sequence[str] = (), **base):
        self.features, self.target, self.base = list(features), target, ENCODED_TREES | base
        self.encoder = RowEncoder(features, size, width, categorical)
        self.trees: JointTrees | None = None

    def fit(self, train: DataFrame) -> EncodedTrees:
        """Action."""
        encoded = staged(self.encoder.fit(train).transform(train).select(quoted(self.target), F.xxhash64(*[quoted(c) for c in self.features]).alias("h"), *self.encoder.names))
        self.trees = JointTrees(self.encoder.names, [Model(self.base)])
        self.trees.fit(encoded, self.target, F.col("h"))
        discard(encoded)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        if self.trees is None:
            raise RuntimeError("call fit first")
        return self.encoder.transform(df).withColumn("prob", self.trees.probability(0)).drop(*self.encoder.names)
