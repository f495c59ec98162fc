"""Messages of the three semantic stages, as Catalyst expressions: documents first and the question last, so that a
service's prefix cache serves later questions on the same documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


MAP = "You are shown source code. Sum up what of it bears on the question, and quote the parts that do."
READ_SOURCE = "I have read the source."
LEFT_OUT = "Name what the answer above left out."


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def labelled(path: Column, text: Column) -> Column:
    """A document under its path, for a batch."""
    return F.concat(F.lit("<<< "), F.coalesce(path, F.lit("")), F.lit(" >>>\n"), F.coalesce(text, F.lit("")), F.lit("\n\n"))


def fenced(question: str) -> Column:
    return F.lit(f"The question is:\n```\n{question.strip()}\n```")


def filter_messages(documents: Column, question: str) -> Column:
    """Which of these outlines matter: five turns, the last an acknowledgement."""
    return F.array(
        _turn("system", F.lit("filter\nYou are shown outlines of source files, each under a line with its path. Name the paths of all files that may bear on the question, one a line.")),
        _turn("user", documents),
        _turn("assistant", F.lit("I have read the outlines.")),
        _turn("user", fenced(question)),
        _turn("assistant", F.lit(f"These paths may bear on it, for the question ```{question.strip()}```")),
    )


def map_messages(path: Column, source: Column, question: str) -> Column:
    """What in this source matters."""
    return F.array(
        _turn("system", F.lit(f"map\n{MAP}")),
        _turn("user", labelled(path, source)),
        _turn("assistant", F.lit(READ_SOURCE)),
        _turn("user", fenced(question)),
    )


def reduce_messages(notes: Column, question: str) -> Column:
    """What of these notes is to be kept."""
    return F.array(
        _turn("system", F.lit("reduce\nYou are shown notes on source files. Keep what bears on the question, with the code that it needs.")),
        _turn("user", notes),
        _turn("assistant", F.lit("I have read the notes.")),
        _turn("user", fenced(question)),
    )


def transcript(messages: Column) -> Column:
    """A conversation as text: each turn behind its role, a blank line between them."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")


def recheck_messages(messages: Column, answer: Column, question: str) -> Column:
    """The second call of a reduction: it sees the first answer and looks for what it lacks."""
    return F.concat(messages, F.array(_turn("assistant", answer), _turn("user", F.concat(F.lit(f"{LEFT_OUT}\n"), fenced(question)))))
