"""Outlines of source files, and their chunks under a token budget."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_map
from ..functions.text import PARSEABLE, suffix
from ..functions.tokens import Counter
from .scanners import CLASS_LIKE, Item, items_of


def tokens(text: str) -> int:
    return (len(text) + 3) // 4


def indent_of(text: str, at: int) -> str:
    """As many blanks as there are bytes on the line before this place."""
    return " " * len(text[text.rfind("\n", 0, at) + 1 : at].encode())


#: What stands in an outline for a declaration's body; declarations of other kinds are captured but not shown.
SHOWN = {**dict.fromkeys(CLASS_LIKE, " {"), "method": " {...}", "field": "", "using": ""}


def outline_line(text: str, x: Item) -> str | None:
    """A declaration's line: without its body, a method from its return type on; null where its kind isn't shown."""
    sign = SHOWN.get(x.kind)
    if sign is None:
        return None
    stop = x.body if sign and x.body is not None else None
    begin = x.sig if x.sig is not None and x.kind == "method" else x.start
    return indent_of(text, x.start) + (text[begin : x.end].rstrip() if stop is None else text[begin:stop].rstrip() + sign)


def outline(text: str | None, extension: str) -> str | None:
    """The declarations' lines in order; the braces of all types that were opened stand at the end, innermost first."""
    if text is None:
        return None
    items = items_of(text, extension)
    shown = filter(None, (outline_line(text, x) for x in items))
    closing = [indent_of(text, x.start) + "}" for x in reversed(items) if x.kind in CLASS_LIKE and x.body is not None]
    return "\n".join([*shown, *closing])


@dataclass(frozen=True)
class Layout:
    """How a file comes apart for its chunks: what may stand before each, how many types that opens, and the spans to pack."""

    head: str
    opened: int
    blocks: list[tuple[int, int]]


def layout(text: str, items: list[Item], python: bool) -> Layout:
    """Classes at the top give their signatures and fields to the head, all else is a block; of blocks within one another only the
    outermost is kept. Python has no head: its classes are blocks."""

    def top_class(x: Item | None) -> Item | None:
        while x is not None and x.kind not in CLASS_LIKE:
            x = x.parent
        return x if x is not None and x.kind == "class" and x.top and not python else None

    lines: list[str] = []
    opened, reach, blocks = 0, -1, []
    for x in sorted(items, key=lambda x: (x.start, -x.end)):
        holder = top_class(x)
        if holder is x:
            lines.append(text[x.start : x.end] if x.body is None else text[x.start : x.body].rstrip() + " {")
            opened += x.body is not None
        elif holder is not None and x.kind == "field":
            lines.append("    " + text[x.start : x.end].lstrip())
        elif x.start >= reach:
            blocks.append((x.start, x.end))
            reach = x.end
    return Layout("\n".join(x.rstrip("\r\n") for x in lines).rstrip(), opened, blocks)


def head_rule(head: str, limit: int, count: Callable[[str], int] = tokens) -> tuple[bool, int]:
    """(does the head stand in each chunk, tokens left for blocks): it does if it takes no more than half."""
    used = head != "" and count(head) <= limit // 2
    return used, limit - count(head) * used


def chunk_text(head: str, opened: int, blocks: list[str]) -> str:
    """Blocks a blank line apart, behind the head if there is one, and the braces of the types that it opens."""
    body = "\n\n".join(blocks).rstrip()
    return "\n\n".join(filter(None, (head, body))) + "\n}" * (opened if head else 0)


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Next-fit over sizes that fit one by one: (first, behind the last) of each group, by search in the prefix sums."""
    sums = [0, *accumulate(sizes)]
    at = 0
    while at < len(sizes):
        stop = bisect_right(sums, sums[at] + limit) - 1
        yield at, stop
        at = stop


def chunks(text: str, extension: str, limit: int, counter: Counter | None = None) -> Iterator[tuple[str, bool]]:
    """(chunk, was something cut) under the limit; separators and closing braces aren't counted. A file without captures gives its
    first tokens, one with fields alone its head."""
    count, cut_to = (counter or Counter()).plain()
    items = items_of(text, extension) if extension in PARSEABLE else []
    if not items:
        yield cut_to(text, limit), count(text) > limit
        return
    plan = layout(text, items, extension == ".py")
    used, budget = head_rule(plan.head, limit, count)
    head = plan.head if used else ""
    if not plan.blocks:
        yield (chunk_text(head, plan.opened, []), False) if used else (cut_to(plan.head, limit), count(plan.head) > limit)
        return
    whole = [text[a:b] for a, b in plan.blocks]
    cut = [count(x) > budget for x in whole]
    parts = [cut_to(x, budget) if over else x for x, over in zip(whole, cut)]
    for a, b in runs([min(budget, count(x)) for x in parts], budget):
        yield chunk_text(head, plan.opened, parts[a:b]), any(cut[a:b])


OUTLINES = "file_id bigint, path string, text string, error string"
PIECES = "file_id bigint, path string, chunk_no int, chunk string, was_truncated boolean, error string"


def outlines(df: DataFrame, id_column: str = "file_id", path_column: str = "file_path", text_column: str = "text") -> DataFrame:
    """The outline of each file with a scanner; a failure becomes the row's error. Null texts have a null outline."""
    rows = df.select(F.col(id_column).cast("bigint").alias("file_id"), F.col(path_column).alias("path"), suffix(F.col(path_column)).alias("ext"), F.col(text_column).alias("text")).where(F.col("ext").isin(*PARSEABLE))

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        for i, path, ext, text in zip(c["file_id"], c["path"], c["ext"], c["text"]):
            try:
                yield i, path, outline(text, ext), None
            except Exception as e:  # noqa: BLE001 - an unreadable file is a row, not the end of the run
                yield i, path, None, f"{type(e).__name__}: {e}"

    return arrow_map(rows, per_batch, OUTLINES)


def chunked(df: DataFrame, limit: int, id_column: str = "file_id", path_column: str = "file_path", text_column: str = "text", counter: Counter | None = None) -> DataFrame:
    """Each file's chunks, numbered from 0. Null texts give one row with a null chunk."""
    rows = df.select(F.col(id_column).cast("bigint").alias("file_id"), F.col(path_column).alias("path"), suffix(F.col(path_column)).alias("ext"), F.col(text_column).alias("text"))

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        for i, path, ext, text in zip(c["file_id"], c["path"], c["ext"], c["text"]):
            if text is None:
                yield i, path, 0, None, False, None
                continue
            try:
                for k, (chunk, cut) in enumerate(chunks(text, ext or "", limit, counter)):
                    yield i, path, k, chunk, cut, None
            except Exception as e:  # noqa: BLE001
                yield i, path, 0, None, False, f"{type(e).__name__}: {e}"

    return arrow_map(rows, per_batch, PIECES)


def captures(df: DataFrame, id_column: str = "file_id", path_column: str = "file_path", text_column: str = "text") -> DataFrame:
    """id, type, start, end of every declaration of the files with a scanner; a scan that fails gives one row with error alone."""
    rows = df.select(F.col(id_column).alias("id"), suffix(F.col(path_column)).alias("ext"), F.col(text_column).alias("text")).where(F.col("text").isNotNull() & F.col("ext").isin(*PARSEABLE))

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        for i, ext, text in zip(c["id"], c["ext"], c["text"]):
            try:
                found = [(i, x.kind, x.start, x.end, None) for x in items_of(text, ext)]
            except Exception as e:  # noqa: BLE001
                found = [(i, None, None, None, f"{type(e).__name__}: {e}")]
            yield from found

    return arrow_map(rows, per_batch, f"id {rows.schema['id'].dataType.simpleString()}, type string, start int, end int, error string").withColumnRenamed("id", id_column)


def top_classes(df: DataFrame, id_column: str = "file_id", path_column: str = "file_path", text_column: str = "text") -> DataFrame:
    """id and the number of classes at the top that have a body, of the files with a scanner; null where the scan fails. Python
    has none, as its chunks have no head; null texts give no rows."""
    rows = df.select(F.col(id_column).cast("bigint").alias("file_id"), suffix(F.col(path_column)).alias("ext"), F.col(text_column).alias("text")).where(F.col("text").isNotNull() & F.col("ext").isin(*PARSEABLE))

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        for i, ext, text in zip(c["file_id"], c["ext"], c["text"]):
            try:
                yield i, layout(text, items_of(text, ext), ext == ".py").opened
            except Exception:  # noqa: BLE001
                yield i, None

    return arrow_map(rows, per_batch, "file_id bigint, classes int")
