"""Codecs: how a text becomes tokens and tokens a text, as functions of columns that operators take as a parameter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import blank, word_tokens


@dataclass(frozen=True)
class Codec:
    """``encode`` gives an array of tokens of any one type, ``decode`` the text of such an array; null texts have no tokens."""

    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))


#: Words and single signs, joined by spaces: inside Spark's own expressions.
WORDS = Codec("regex", word_tokens, lambda tokens: F.array_join(tokens, " "))


@lru_cache(maxsize=2)
def _loaded(vocabulary: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


def vocabulary_codec(spark: SparkSession, path: str, name: str | None = None) -> Codec:
    """The codec of a vocabulary file of the tokenizers library, without special tokens added.

    The driver reads the file, and every task gets it from there, so executors
    need no file of their own; what is sent is as large as the vocabulary.
    Whole texts go through it in Arrow batches.
    """
    with open(path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([x.ids for x in _loaded(sent.value).encode_batch(texts.tolist(), add_special_tokens=False)], dtype=object)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series(_loaded(sent.value).decode_batch([list(x) for x in ids], skip_special_tokens=False), dtype=object)

    return Codec(name or path.rsplit("/", 1)[-1], lambda text: encode(blank(text)), lambda tokens: decode(F.coalesce(tokens, F.array().cast("array<int>"))))
