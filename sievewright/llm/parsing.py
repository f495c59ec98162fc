"""Problem 3: source files that do not parse.

Method: recursive-descent statements with precedence-climbing expressions and panic-mode recovery (modules syntax, csharp,
javascript, python_syntax). All errors are stored, the first as the cause. Statements may nest as deep as DEEPEST calls go; a
text beyond that is neither accepted nor rejected.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map
from .syntax import languages

#: The extensions, in any case, and the name of the language that each stands for.
LANGUAGES = {"py": "Python", "java": "Java", "cs": "C#", "js": "JavaScript", "json": "JSON"}
#: Calls of the parser within each other, some six a level of a text's nesting.
DEEPEST = 200_000
PARSED = "file_id bigint, language string, accepted boolean, n_errors int, first_line int, first_cause string, errors array<struct<line:int,cause:string>>"


def errors_of(text: str, extension: str) -> list[tuple[int, str]]:
    """(line, cause) of each error, the first cause first; an empty list is a valid text. RecursionError: it nests too deeply."""
    text = text.removeprefix("﻿")
    if extension != "json" and not text.strip():
        return []
    if sys.getrecursionlimit() < DEEPEST:
        sys.setrecursionlimit(DEEPEST)
    parser = languages()[extension](text)
    found = parser.check()
    return list(zip(parser.lines_of([at for at, _ in found]), [cause for _, cause in found]))


def parse_files(df: DataFrame, id_column: str = "file_id", path_column: str = "file_path", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each file whose extension names a language, in PARSED's columns and those string columns that are to be kept;
    accepted is null where a text nests too deeply to tell.

    Null texts and paths and other extensions give no rows; empty texts are valid but for JSON; repeated rows count by their
    own ids; an empty table gives no rows; other columns are not looked at. No shuffle."""
    extension = F.lower(F.regexp_extract(F.col(path_column), r"\.([^./]+)$", 1))
    rows = df.select(F.col(id_column).cast("bigint").alias("file_id"), extension.alias("ext"), F.col(text_column).alias("text"), *keep)
    rows = rows.where(F.col("text").isNotNull() & F.col("ext").isin(*LANGUAGES))

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        for i, ext, text, *kept in zip(c["file_id"], c["ext"], c["text"], *[c[k] for k in keep]):
            try:
                found = errors_of(text, ext)
            except RecursionError:
                yield i, LANGUAGES[ext], None, None, None, "nested too deeply", None, *kept
                continue
            first = found[0] if found else (None, None)
            yield i, LANGUAGES[ext], not found, len(found), *first, [{"line": a, "cause": b} for a, b in found], *kept

    return arrow_map(rows, per_batch, PARSED + "".join(f", {k} string" for k in keep))


def rates(df: DataFrame) -> DataFrame:
    """repo, language, n_files, n_rejected, share of the files that are parsed; a null repository is a group of its own."""
    return _rates(parse_files(df, keep=("repo",)), "repo", "language")


def acceptance(df: DataFrame) -> DataFrame:
    """language, n_files, n_rejected, share, n_accepted and the most frequent first cause of a rejection."""
    parsed = parse_files(df)
    causes = parsed.where("not accepted").groupBy("language", "first_cause").agg(F.count("*").alias("n"))
    causes = causes.groupBy("language").agg(F.max_by("first_cause", F.struct("n", "first_cause")).alias("most_frequent_cause"))
    out = _rates(parsed, "language").withColumn("n_accepted", F.col("n_files") - F.col("n_rejected"))
    return out.join(causes, "language", "left")


def _rates(parsed: DataFrame, *by: str) -> DataFrame:
    rejected = F.sum(F.coalesce(~F.col("accepted"), F.lit(False)).cast("bigint"))
    return parsed.groupBy(*by).agg(F.count("*").alias("n_files"), rejected.alias("n_rejected")).withColumn("share", F.col("n_rejected") / F.col("n_files"))
