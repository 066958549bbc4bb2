"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of the vocabulary goes on across a whitespace marker, the pieces of a text are the pieces of its marked words.
Every distinct marked word of a batch is segmented once by the library and kept in a table; ids and surfaces are then joined
back by position. The table lives in the worker (at most MAX_CHUNKS entries, then it starts anew): a shuffle that joined every
word of the corpus with one global table would write many times the input.

Edge cases: a null text counts as empty and has no ids. Runs of spaces belong to the word that follows them. Texts of any
length are encoded whole. Repeated rows get equal results; all other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
MAX_CHUNKS = 800_000
_TABLES: dict[int, "ChunkTable"] = {}


class ChunkTable:
    """Distinct chunk (without its first marker) -> its ids as text, joined by commas."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in x.lstrip(MARK) for x in names) or self.library.encode("a" + MARK + " a") != self.library.encode("a  a"):
            raise ValueError("pieces of this model cross whitespace markers, or it changes white space")
        self.alone = self.library.piece_to_id(MARK)
        self.guard = self.library.piece_to_id("a")
        self.texts = [str(i) for i in range(len(names))]
        #: What each id shows as; null where only the library can tell (bytes, control and unknown pieces).
        odd = (self.library.is_byte, self.library.is_control, self.library.is_unknown, self.library.is_unused)
        self.shown = [None if any(f(i) for f in odd) else x.replace(MARK, " ") for i, x in enumerate(names)]
        self.rows: dict[str, str] = {}
        #: Chunks that do not show as they were written.
        self.changed: dict[str, str] = {}

    def keys(self, text: str) -> list[str]:
        """The chunks of a text in order; the library puts a marker before the first word."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in CHUNK.findall(MARK + text.replace(" ", MARK))]

    def surface(self, ids: list[int]) -> str:
        """What the ids show inside a text, with the space of the first marker."""
        parts = [self.shown[i] for i in ids]
        return self.library.decode([self.guard, *ids])[1:] if None in parts else "".join(parts)

    def learn(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self.rows]
        if len(self.rows) + len(new) > MAX_CHUNKS:
            self.rows.clear()
            self.changed.clear()
            new = list(keys)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for k, ids in zip(part, self.library.encode(part)):
                ids = ids if k else [self.alone]
                self.rows[k] = ",".join([self.texts[i] for i in ids])
                shown = self.surface(ids)
                if shown != " " + k.replace(MARK, " "):
                    self.changed[k] = shown

    def lookup(self, text: str | None) -> tuple[str, str]:
        """All ids as text, and what the library's decode() returns for them: the first marker shows no space."""
        keys = self.keys(text or "")
        try:
            listed = ",".join([self.rows[k] for k in keys])
        except KeyError:
            self.learn(set(keys))
            listed = ",".join([self.rows[k] for k in keys])
        if self.changed and not self.changed.keys().isdisjoint(keys):
            return listed, "".join([self.changed.get(k, " " + k.replace(MARK, " ")) for k in keys])[1:]
        return listed, (text or "").replace(MARK, " ")


def table_of(model: bytes) -> ChunkTable:
    key = hash(model)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = ChunkTable(model)
    return _TABLES[key]


def _shared(docs: DataFrame, model_path: str):
    with open(model_path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, model_path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """All rows and columns, with the ids of the text as array<int>."""
    model = _shared(docs, model_path)

    @pandas_udf("array<int>")
    def ids(values: pd.Series) -> pd.Series:
        table = table_of(model.value)
        return pd.Series([[int(i) for i in x.split(",")] if x else [] for x in (table.lookup(v)[0] for v in values)])

    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All rows and columns, with the text of an array of ids."""
    model = _shared(docs, model_path)

    @pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        library = table_of(model.value).library
        return pd.Series([library.decode([int(i) for i in x]) if x is not None else "" for x in values])

    return docs.withColumn(into, texts(F.col(ids)))


def round_trip(docs: DataFrame, model_path: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """All rows and columns, with a struct (n_tokens, ids_sha256, decoded_sha256), without writing out the ids."""
    model = _shared(docs, model_path)

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def judged(values: pd.Series) -> pd.DataFrame:
        table, out = table_of(model.value), []
        for v in values:
            ids, shown = table.lookup(v)
            digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (ids, shown)]
            out.append((ids.count(",") + 1 if ids else 0, *digests))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(into, judged(F.col(text)))
