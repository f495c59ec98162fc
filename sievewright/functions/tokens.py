"""Token counts and truncation. By default a token is four characters, as SQL, so that no Python worker is needed."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def token_count(text: Column) -> Column:
    """(length + 3) div 4; null and empty texts count 0."""
    return F.coalesce(F.floor((F.length(text) + 3) / 4).cast("int"), F.lit(0))


def token_count_regex(text: Column) -> Column:
    """Words and single signs."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0))), F.lit(0))


def truncate(text: Column, limit: int) -> Column:
    """The first tokens; a text within the limit stays as it is."""
    return F.when(token_count(text) > limit, F.substring(text, 1, 4 * limit)).otherwise(text)


def was_truncated(text: Column, limit: int) -> Column:
    return token_count(text) > limit


class Counter:
    """Counts and cuts in tokens of four characters, in Catalyst and in Python alike."""

    def count(self, text: Column) -> Column:
        return token_count(text)

    def cut(self, text: Column, limit: int) -> Column:
        return truncate(text, limit)

    def plain(self) -> tuple[Callable[[str], int], Callable[[str, int], str]]:
        """The same for single texts, in a worker."""
        return lambda text: (len(text) + 3) // 4, lambda text, limit: text[: 4 * limit]


@lru_cache(maxsize=4)
def _tokenizer(name: str):
    from pyspark import SparkFiles
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(SparkFiles.get(name))
    t.encode_special_tokens = True
    return t


def _offsets(name: str, text: str) -> list[tuple[int, int]]:
    return _tokenizer(name).encode(text, add_special_tokens=False).offsets


class BpeCounter(Counter):
    """Counts by a tokenizer's file, which is shipped to the workers; no start or end tokens are added, and a text is cut where
    its last whole token that fits ends."""

    def __init__(self, spark: SparkSession, file: str) -> None:
        spark.sparkContext.addFile(file)
        self.name = os.path.basename(file)

    def count(self, text: Column) -> Column:
        name = self.name

        @F.pandas_udf(IntegerType())
        def counted(texts):
            import pandas as pd

            return pd.Series([len(_offsets(name, x or "")) for x in texts], dtype="int32")

        return counted(text)

    def cut(self, text: Column, limit: int) -> Column:
        cut = self.plain()[1]

        @F.pandas_udf(StringType())
        def shortened(texts):
            import pandas as pd

            return pd.Series([None if x is None else cut(x, limit) for x in texts], dtype=object)

        return shortened(text)

    def plain(self) -> tuple[Callable[[str], int], Callable[[str, int], str]]:
        name = self.name

        def cut(text: str, limit: int) -> str:
            offsets = _offsets(name, text)
            return text if len(offsets) <= limit else text[: offsets[limit - 1][1]] if limit else ""

        return lambda text: len(_offsets(name, text)), cut
