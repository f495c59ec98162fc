"""Public tokenizers' vocabularies, read from a path that is a parameter; nothing is trained or copied."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Where the vocabulary files lie unless the caller or the environment says otherwise.
FOLDER = os.environ.get("SIEVEWRIGHT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the byte-level vocabularies cut text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def path(name: str) -> str:
    return f"{FOLDER}/{name}"


def ship(spark, file: str) -> str:
    """Send a vocabulary file to the executors; its name there."""
    spark.sparkContext.addFile(file)
    return os.path.basename(file)


def place(name: str) -> str:
    """Where a shipped file lies on this machine."""
    from pyspark import SparkFiles

    return SparkFiles.get(name)


@lru_cache(maxsize=4)
def byte_bpe(file: str):
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(file, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
