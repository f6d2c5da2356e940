"""Building a vector index: cleaned texts, checked vectors, and each different text encoded once.

An encoder is any picklable function from a list of texts to a list of vectors; it may raise on texts that it does not take.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts given to an encoder at once, and the characters of a cleaned text.
BATCH, MOST_CHARS = 64, 2400
# What stands for punctuation beyond ASCII.
PUNCTUATION = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "..."}
_SPACE = r"[\s\x1c-\x1f]"

Encoder = Callable[[list[str]], list[list[float]]]


@lru_cache(maxsize=1 << 16)
def _folded(char: str) -> str:
    """What a character beyond ASCII becomes, after compatibility composition: a letter of the Latin script its ASCII letters, a number itself."""
    kind = unicodedata.category(char)
    if kind.startswith("N") or char in PUNCTUATION:
        return char
    if kind.startswith("L") and "LATIN" in unicodedata.name(char, ""):
        return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode() or " "
    return " "


def _normal_forms(texts: pd.Series) -> pd.Series:
    fold = lambda t: "".join(x if x < "\x80" else _folded(x) for x in unicodedata.normalize("NFKC", t))
    return texts.map(lambda t: t if t is None or t.isascii() else fold(t))


def clean(text: Column) -> Column:
    """A text as encoders take it: compatible forms, ASCII punctuation, Latin letters without marks, no long rules, single spaces, at most MOST_CHARS.

    Null stays null. Only Unicode forms need Python (on Arrow batches); the maps are column functions.
    """
    out = F.pandas_udf(_normal_forms, "string")(text)
    for char, plain in PUNCTUATION.items():
        out = F.replace(out, F.lit(char), F.lit(plain))
    out = F.regexp_replace(out, r"([.\-_])\1{3,}", " ... ")
    out = F.regexp_replace(out, r"([=*~])\1{3,}", " ")
    out = F.btrim(F.regexp_replace(out, f"{_SPACE}+", " "))
    cut = F.left(out, F.lit(MOST_CHARS))
    return F.when(F.char_length(out) <= MOST_CHARS, out).otherwise(F.coalesce(F.nullif(F.regexp_extract(cut, r"(?s)^(.*) ", 1), F.lit("")), cut))


def vector_fault(vector: Column) -> Column:
    """Why a vector cannot be stored, null if it can: it has to be a list of finite numbers that is not empty."""
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), "empty")
        .when(F.exists(vector, lambda x: x.isNull()), "not a number")
        .when(F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
    )


def _tried(encoder: Encoder, texts: list[str]) -> list[list[float]]:
    found = encoder(texts)
    if len(found) != len(texts):
        raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
    return [[float(x) for x in v] for v in found]


def encode(texts: DataFrame, encoder: Encoder, batch: int = BATCH) -> DataFrame:
    """texts(digest, text, cleaned) as digest, embedding, way, error.

    A batch that fails is tried text by text (way is `encoded` either way), a text that fails once more as cleaned (`cleaned`); what fails then
    is a row with way `failed` and the error.
    """

    def one(text: str, cleaned: str) -> tuple[list[float] | None, str, str | None]:
        try:
            return _tried(encoder, [text])[0], "encoded", None
        except Exception as error:
            if not cleaned or cleaned == text:
                return None, "failed", str(error)
        try:
            return _tried(encoder, [cleaned])[0], "cleaned", None
        except Exception as error:
            return None, "failed", str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start : start + batch]
                try:
                    found = [(v, "encoded", None) for v in _tried(encoder, part["text"].tolist())]
                except Exception:
                    found = [one(t, x) for t, x in zip(part["text"], part["cleaned"], strict=True)]
                yield pd.DataFrame({"digest": part["digest"].to_numpy(), **{n: [f[i] for f in found] for i, n in enumerate(("embedding", "way", "error"))}})

    return texts.mapInPandas(run, "digest string, embedding array<double>, way string, error string")


def build(chunks: DataFrame, encoder: Encoder, text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """chunks with embedding, way and error; every different text is encoded once, wherever it stands.

    Null texts count as empty. Vectors that fail vector_fault become failures. Repeated texts are combined in the map tasks; rows meet their vector by
    the text's digest, and do not carry the text there twice.
    """
    own = [x for x in chunks.columns if x not in ("embedding", "way", "error")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = chunks.select(*own, F.sha2(text, 256).alias("_digest"))
    distinct = chunks.select(F.sha2(text, 256).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    found = encode(distinct.withColumn("cleaned", clean(F.col("text"))), encoder, batch)
    fault = F.when(F.col("way") != "failed", vector_fault(F.col("embedding")))
    checked = found.select(
        F.col("digest").alias("_digest"),
        F.when(fault.isNull(), F.col("embedding")).alias("embedding"),
        F.when(fault.isNull(), F.col("way")).otherwise("failed").alias("way"),
        F.coalesce("error", fault).alias("error"),
    )
    return keyed.join(checked, "_digest", "left").drop("_digest")


class WordShapes:
    """A deterministic encoder for tests and queries: counts of words by a number made of their first and last letters and length; blank texts raise."""

    def __init__(self, dims: int = 8):
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
            vector = [0.0] * self.dims
            for w in words:
                if w:
                    vector[(31 * ord(w[0]) + 17 * ord(w[-1]) + len(w)) % self.dims] += 1.0
            if not any(vector):
                raise ValueError("a blank text has no vector")
            out.append(vector)
        return out
