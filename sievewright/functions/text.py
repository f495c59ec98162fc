"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: extensions with a scanner.
PARSEABLE = (".java", ".py", ".cs")


def suffix(path: Column) -> Column:
    """The lower-case extension with its dot; empty where there is none, as for .bashrc, Makefile or d.e/f."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def parseable(path: Column) -> Column:
    return F.coalesce(suffix(path).isin(*PARSEABLE), F.lit(False))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def right_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def indentation(line: Column) -> Column:
    return F.regexp_extract(line, r"^[ \t]*", 0)


def byte_slice(text: Column, start: int, length: int) -> Column:
    """Bytes of the UTF-8 form, counted from 0."""
    return F.substring(F.encode(text, "UTF-8"), start + 1, length)


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def newlines(text: Column) -> Column:
    return occurrences(text, "\n")


def error_text(message: Column, path: Column, cause: Column) -> Column:
    """Message, file and original cause, as far as each is known."""
    return F.concat(F.coalesce(message, F.lit("")), F.when(path.isNotNull(), F.concat(F.lit(" [File: "), path, F.lit("]"))).otherwise(""), F.when(cause.isNotNull(), F.concat(F.lit(" (Original exception: "), cause, F.lit(")"))).otherwise(""))
