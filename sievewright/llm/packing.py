"""Problem 6: fill containers of fixed capacity with texts.

Method: only the histogram of lengths is planned. Best fit, longest first, runs over counts: a class of containers with
equal space left is one range of container numbers, and a run of equal items goes into it as one range of slots. The
plan's size depends on the capacity, not on the data. Documents then take slots by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vocab
from .base import arrow_map, materialize

#: Rows of one length are ranked in so many groups at least, and as many as keep a group under so many rows whatever their lengths.
RANK_GROUPS, GROUP_ROWS = 64, 500_000
#: Rows of a few numbers that are sent to every executor at most.
SENT_ROWS = 200_000
PLAN = "n_tokens int, first_rank bigint, last_rank bigint, first_container bigint, each int"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit plan for items of length 1..capacity: rows (length, first rank, last rank, first container, items a container).

    The item of rank r in such a row goes to container first + (r - first rank) // items a container."""
    room: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []  # sorted keys of room, kept by insertion
    from bisect import bisect_left, insort

    def put(space: int, first: int, count: int) -> None:
        if space <= 0 or count <= 0:
            return
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((first, count))

    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        changed: list[tuple[int, int, int]] = []
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, count = room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop(k)
            else:
                space, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            each = space // length
            full = min(count, left // each)
            if full:
                rows.append((length, rank, rank + full * each - 1, first, each))
                changed.append((space - each * length, first, full))
                rank, left = rank + full * each, left - full * each
            if left and full < count:  # fewer than a container takes
                rows.append((length, rank, rank + left - 1, first + full, left))
                changed.append((space - left * length, first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            put(space, first + full, count - full)
        for x in changed:  # none of these takes another item of this length, but for the last, which ended the run
            put(*x)
    return rows


def count_tokens(df: DataFrame, tokenizer: str | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens) of every row. tokenizer: a file of byte-level BPE ranks; None counts four characters a token.

    Null texts count 0 tokens, like empty ones. The file is shipped to the executors, which need not have it."""
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    if tokenizer is None:
        return rows.select("id", F.coalesce(F.expr("(length(text) + 3) div 4"), F.lit(0)).cast("int").alias("n_tokens"))

    shipped = vocab.ship(df.sparkSession, tokenizer)

    def setup():
        encode = vocab.byte_bpe(vocab.place(shipped)).encode_ordinary

        def count(c: dict[str, list]) -> Iterator[tuple]:
            for i, text in zip(c["id"], c["text"]):
                yield i, len(encode(text)) if text else 0

        return count

    return arrow_map(rows, None, "id bigint, n_tokens int", setup)


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """Assign (id, n_tokens) rows to containers: id, piece_no, token_start, n_tokens, container_id.

    An item over the capacity is cut into full pieces, each alone in a container, and a last piece that is packed like any
    item; nothing else is split. Containers are numbered from 0, those of full pieces last. Items of 0 tokens (null and empty texts) and null sizes come back with a null container. Ids may repeat; each
    row is an item of its own. An empty table gives no rows."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    items = materialize(sizes.select("id", F.coalesce("n_tokens", F.lit(0)).alias("t")), "pack-sizes")
    # Ranks are taken in groups of a length, as many as keep a group small if all rows had one length.
    groups = max(RANK_GROUPS, -(-items.count() // GROUP_ROWS))
    parts = (
        items.withColumn("whole", F.when(F.col("t") > capacity, F.expr(f"t div {capacity}")).otherwise(F.lit(0).cast("bigint")))
        .withColumn("last", (F.col("t") - F.col("whole") * capacity).cast("int"))
        .withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    )
    rest = parts.where("last > 0").select("id", F.col("whole").cast("int").alias("piece_no"), (F.col("whole") * capacity).cast("int").alias("token_start"), F.col("last").alias("n_tokens"), "g")
    counts = materialize(rest.groupBy("n_tokens", "g").agg(F.count("*").alias("n")), "pack-counts")  # at most capacity x groups rows
    histogram = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows = plan(histogram, capacity)
    opened = max((first + -(-(b - a + 1) // each) for _, a, b, first, each in rows), default=0)
    before = counts.select("n_tokens", "g", F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rest.withColumn("k", F.row_number().over(Window.partitionBy("n_tokens", "g").orderBy("id", "piece_no")))
    ranked = ranked.join(_small(before, len(histogram) * groups), ["n_tokens", "g"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    slots = spark.createDataFrame(rows, PLAN).withColumnRenamed("n_tokens", "l")
    placed = ranked.join(_small(slots, len(rows)), (F.col("n_tokens") == F.col("l")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    placed = placed.select("id", "piece_no", "token_start", "n_tokens", (F.col("first_container") + F.expr("(rank - first_rank) div each")).cast("bigint").alias("container_id"))
    # Full pieces fill the containers behind the planned ones: their row's place among all of them is a sum over the groups
    # before and over the rows before within the group.
    full = parts.where("whole > 0").select("id", "whole", "g")
    sums = full.groupBy("g").agg(F.sum("whole").alias("n"))  # a row a group
    offsets = sums.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.coalesce(F.sum("whole").over(Window.partitionBy("g").orderBy("id", "whole").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = full.withColumn("within", within).join(_small(offsets, groups), "g").select("id", (F.col("offset") + F.col("within")).alias("u"), F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("piece_no"))
    whole = whole.select("id", "piece_no", (F.col("piece_no") * capacity).cast("int").alias("token_start"), F.lit(capacity).alias("n_tokens"), (F.lit(opened) + F.col("u") + F.col("piece_no")).cast("bigint").alias("container_id"))
    none = parts.where("t <= 0").select("id", F.lit(0).alias("piece_no"), F.lit(0).alias("token_start"), F.lit(0).alias("n_tokens"), F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(whole).unionByName(none)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """To be sent to every executor if its known number of rows allows it, else as the planner chooses."""
    return F.broadcast(df) if rows <= SENT_ROWS else df
