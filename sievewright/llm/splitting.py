"""Problem 5: cut oversized items at natural boundaries.

Method: token offsets are prefix sums over the text; boundaries are kept as one sorted array for each rank; a piece ends
at the last boundary of the best rank under the limit (binary search), the next piece starts the stated overlap before
that end, and where no boundary fits the cut is hard.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .base import arrow_map

CODE, MARKUP, DATA = "code", "prose", "data"
#: Which extensions hold which kind of content.
KINDS = {"py": CODE, "java": CODE, "cs": CODE, "js": CODE, "sh": CODE, "sql": CODE, "md": MARKUP, "txt": MARKUP, "rst": MARKUP}
#: A piece is filled at least so far before a better rank of boundary is given up for a later, weaker one.
LEAST_FILL = 0.5

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_CLOSER = re.compile(r"[\s})\];,]*[})\]][\s})\];,]*$")
_HELD = re.compile(r'"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|/\*.*?\*/|^```.*?^```[^\n]*$', re.S | re.M)
_STATEMENT = re.compile(r"[;}\],](?=\S)|[.!?;,]\s+|[。！？]")
_SPACE = re.compile(r"\s+(?=\S)")
_HEADING = re.compile(r"#{1,6} |={3,}|-{3,}$")


def kind_of(path: str | None) -> str:
    return KINDS.get((path or "").rsplit(".", 1)[-1].lower(), DATA)


def boundaries(text: str, kind: str) -> list[list[int]]:
    """Sorted character offsets at which a piece may end, best rank first.

    0 top-level declaration, heading or entry; 1 second level; 2 after a blank line, a closed block or a statement not far in; 3 line; 4 statement,
    sentence or list item; 5 word. Offsets inside block comments, long strings and fenced blocks get rank 3 at best."""
    ranks: list[list[int]] = [[] for _ in range(6)]
    held = [(m.start(), m.end()) for m in _HELD.finditer(text)]
    starts = [a for a, _ in held]
    blank, closed, comment, opened = False, False, False, False
    at = 0
    for m in _LINE.finditer(text):
        line = m.group()
        if not line:
            break
        at = m.start()
        body = line.strip()
        if at and body:
            k = bisect_right(starts, at - 1) - 1
            inside = k >= 0 and held[k][0] < at < held[k][1]
            depth = len(line) - len(line.lstrip(" \t"))
            closes = bool(_CLOSER.match(body))
            if inside or comment or closes:
                rank = 3
            elif kind == MARKUP:
                rank = 0 if _HEADING.match(body) and blank else 1 if blank else 3
            elif kind == CODE:
                rank = (0 if depth == 0 else 1 if depth <= 4 else 2) if blank or closed and depth <= 4 else 2 if closed or depth <= 8 and not opened else 3
            else:
                rank = 0 if depth == 0 or body[0] == "[" else 1 if depth <= 2 else 2 if depth <= 4 else 3
            ranks[rank].append(at)
        if body:
            comment = body.startswith(("//", "#", "@", "*", "--", "[")) and kind == CODE
            closed, blank, opened = bool(_CLOSER.match(body)), False, body[-1] in ":{([,+=\\"
        else:
            blank = True
    ranks[4] = [m.end() for m in _STATEMENT.finditer(text)]
    ranks[5] = [m.end() for m in _SPACE.finditer(text)]
    return ranks


def pieces(text: str, kind: str, max_tokens: int, overlap_tokens: int, ends: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(start, end, rank of the end) of each piece; rank 6 is a hard cut, 7 the end of the text.

    ends: the character offset at which each token ends; without it a token is four characters, the last one up to four."""
    if max_tokens <= 0 or overlap_tokens < 0 or overlap_tokens >= max_tokens:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    n = len(text)
    if ends is None:
        reach = lambda start: min(n, start + 4 * max_tokens)
        back = lambda end: max(0, end - 4 * overlap_tokens)
    else:
        sums = [0, *ends]

        def reach(start: int) -> int:
            k = bisect_right(sums, start) - 1 + max_tokens
            if k >= len(sums) - 1:
                return n
            if sums[k + 1] == sums[k]:  # a character of several tokens that don't all fit
                before = sums[bisect_left(sums, sums[k]) - 1]
                return before if before > start else sums[k]
            return sums[k]

        back = lambda end: sums[max(0, bisect_right(sums, end) - 1 - overlap_tokens)]
    ranks = boundaries(text, kind)
    if ends is not None:
        on_token = set(sums)
        ranks = [[x for x in r if x in on_token] for r in ranks]
    start = 0
    while True:
        limit = reach(start)
        if limit >= n:
            yield start, n, 7
            return
        cut, rank = limit, 6
        for least in (start + int((limit - start) * LEAST_FILL), start):
            for r, offsets in enumerate(ranks if least > start else ranks[:4]):
                k = bisect_right(offsets, limit) - 1
                if k >= 0 and offsets[k] > least and back(offsets[k]) > start:
                    cut, rank = offsets[k], r
                    break
            if rank < 6:
                break
        if rank == 6 and ends is None and text[cut - 1] == "\r" and text[cut] == "\n" and back(cut - 1) > start:
            cut -= 1
        yield start, cut, rank
        step = back(cut)
        start = step if step > start else cut


def tokens_of(length: int) -> int:
    return (length + 3) // 4


def token_ends(text: str, encoding) -> list[int]:
    """The character offset at which each token of the text ends, the prefix sums of their lengths. Tokens that share a character
    all end behind it."""
    _, starts = encoding.decode_with_offsets(encoding.encode_ordinary(text))
    ends, end = [], len(text)
    for k in range(len(starts) - 1, -1, -1):
        ends.append(end)
        if k and starts[k - 1] < starts[k]:
            end = starts[k]
    return ends[::-1]


PIECES = "id bigint, piece_no int, start int, end int, n_tokens int, break_rank int, piece string"


def split_oversized(df: DataFrame, max_tokens: int, overlap_tokens: int, id_column: str = "file_id", path_column: str = "file_path", text_column: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Pieces of every row whose text is over max_tokens, in PIECES' columns; start and end count characters.

    tokenizer: a file of byte-level BPE ranks, which is shipped to the executors; None counts four characters a token, and then
    the size test runs in the JVM before anything is sent to Python. Nulls and texts within the limit (empty ones too) give no
    rows; a null path counts as plain data; repeated rows are cut alike under their own ids; an empty table gives no rows; other
    columns are not looked at, whatever their names. No shuffle is needed."""
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(path_column).alias("path"), F.col(text_column).alias("text"))
    if tokenizer is None:
        over = rows.where(F.expr("(length(text) + 3) div 4") > F.lit(max_tokens))
    else:
        over = rows.where(F.octet_length("text") > F.lit(max_tokens))  # a token has a byte at least
        shipped = vocab.ship(df.sparkSession, tokenizer)

    def setup():
        encoding = None if tokenizer is None else vocab.byte_bpe(vocab.place(shipped))

        def cut(c: dict[str, list]) -> Iterator[tuple]:
            for i, path, text in zip(c["id"], c["path"], c["text"]):
                ends = None if encoding is None else token_ends(text, encoding)
                if ends is not None and len(ends) <= max_tokens:
                    continue
                for k, (a, b, rank) in enumerate(pieces(text, kind_of(path), max_tokens, overlap_tokens, ends)):
                    n = tokens_of(b - a) if ends is None else bisect_right(ends, b) - bisect_right(ends, a)
                    yield i, k, a, b, n, rank, text[a:b]

        return cut

    return arrow_map(over, None, PIECES, setup)
