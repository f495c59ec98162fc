"""Next-fit packing in a given order, exact and distributed.

The order is cut into blocks. What a block does depends only on the tokens that the open group brings along: at the first
row that no longer fits a group begins afresh, and from there on all is settled. So each block is summed up as the few
places where that first group may begin with what follows from each; the summaries are composed in order, in tasks, and a
second pass numbers the groups."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import materialize

#: Rows of one block at most, about: they lie in a task's memory.
BLOCK_ROWS = 500_000
#: Summaries that one task puts together.
FAN = 64


def next_fit(sizes: list[int], limit: int, carried: int = 0, group: int = 0) -> tuple[list[int], int, int]:
    """(group of each, tokens in the last group, its number); carried tokens lie in the open group already, -1: none is open."""
    out = []
    for t in sizes:
        if carried < 0:
            carried = 0
        elif carried + t > limit:
            group, carried = group + 1, 0
        carried += t
        out.append(group)
    return out, carried, group


def summary(sizes: list[int], limit: int) -> tuple[list[int], list[int], list[int], int]:
    """(needs, groups, carries, total): with carried tokens c, the first new group begins at the first place whose need is
    over limit - c; groups begun and tokens carried on follow. With none such, c + total is carried on."""
    n = len(sizes)
    # From the end: what follows when a group begins at row i.
    sums = [0]
    for t in sizes:
        sums.append(sums[-1] + t)
    begun, carry = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        k = bisect_right(sums, sums[i] + limit) - 1  # the first row that no longer fits
        if k >= n:
            begun[i], carry[i] = 1, sums[n] - sums[i]
        else:
            begun[i], carry[i] = begun[k] + 1, carry[k]
    needs, groups, carries = [], [], []
    for i in range(n):
        need = sums[i + 1]
        if needs and need == needs[-1]:
            continue
        needs.append(need)
        groups.append(begun[i])
        carries.append(carry[i])
        if need > limit:
            break
    return needs, groups, carries, sums[n]


Summary = tuple[list[int], list[int], list[int], int]


def follow(s: Summary, carried: int, limit: int) -> tuple[int, int]:
    """(groups begun, tokens in the open one) after a block into which these tokens are carried; -1: no group is open."""
    needs, groups, carries, total = s
    carried = max(0, carried)
    k = bisect_right(needs, limit - carried)
    return (groups[k], carries[k]) if k < len(needs) else (0, carried + total)


def then(f: Summary, g: Summary, limit: int) -> Summary:
    """The summary of two blocks in a row; like each of them it has no more entries than the limit has tokens, and one."""
    after = [follow(g, c, limit) for c in f[2]]
    needs, groups, carries = list(f[0]), [n + m for n, (m, _) in zip(f[1], after)], [c for _, c in after]
    if not needs or needs[-1] <= limit:
        for need, n, c in zip(*g[:3]):
            if not needs or need + f[3] > needs[-1]:
                needs.append(need + f[3])
                groups.append(n)
                carries.append(c)
                if needs[-1] > limit:
                    break
    return needs, groups, carries, f[3] + g[3]


def compose(summaries: list[Summary], limit: int, carried: int = -1, group: int = 0) -> list[tuple[int, int]]:
    """For each block the tokens carried into it (-1: no group is open) and the number of the open group."""
    out = []
    for s in summaries:
        out.append((carried, group))
        begun, carried_on = follow(s, carried, limit)
        if s[3] or s[0] or carried >= 0:
            group, carried = group + begun, carried_on
    return out


SUMMED = "block bigint, needs array<bigint>, groups array<bigint>, carries array<bigint>, total bigint"


def _summaries(pdf: pd.DataFrame) -> list[Summary]:
    pdf = pdf.sort_values("block")
    return [(list(a), list(b), list(c), int(t)) for a, b, c, t in zip(pdf["needs"], pdf["groups"], pdf["carries"], pdf["total"])]


def starts(summed: DataFrame, n: int, limit: int) -> dict[int, tuple[int, int]]:
    """compose's result for all blocks. Summaries are put together FAN at a time in tasks, level by level, so that no more than
    FAN of them reach the driver, and of each block two numbers."""
    if n <= FAN:
        rows = summed.orderBy("block").collect()
        return dict(zip([r["block"] for r in rows], compose([(r["needs"], r["groups"], r["carries"], r["total"]) for r in rows], limit)))
    above = summed.withColumn("above", F.expr(f"block div {FAN}"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        needs, groups, carries, total = reduce(lambda f, g: then(f, g, limit), _summaries(pdf))
        return pd.DataFrame({"block": [pdf["above"].iloc[0]], "needs": [needs], "groups": [groups], "carries": [carries], "total": [total]})

    upper = starts(materialize(above.groupBy("above").applyInPandas(merge, SUMMED), "pack-summaries"), -(-n // FAN), limit)

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        each = compose(_summaries(pdf), limit, *upper[int(pdf["above"].iloc[0])])
        return pd.DataFrame({"block": sorted(pdf["block"]), "carried": [c for c, _ in each], "number": [g for _, g in each]})

    return {r["block"]: (r["carried"], r["number"]) for r in above.groupBy("above").applyInPandas(spread, "block bigint, carried bigint, number bigint").toLocalIterator()}


def pack(df: DataFrame, order: list[str], tokens: Column, limit: int, blocks: int | None = None) -> DataFrame:
    """df's rows within the limit with group_id (from 0, in order), is_large false; larger ones with is_large true and no group.

    A null size counts 0, so empty texts join a group; null keys come first; ties in the order are broken by nothing else, so
    give a total order; an empty table stays empty. df's own columns group_id, is_large, t and block are replaced. All
    columns travel with the rows: give ids and paths rather than texts."""
    if limit < 0:
        raise ValueError("the limit must not be negative")
    columns = [c for c in df.columns if c not in ("group_id", "is_large", "t", "block")]
    sized = materialize(df.select(*columns, F.coalesce(tokens.cast("bigint"), F.lit(0)).alias("t")), "pack-sizes")
    small, large = oversize(sized, limit)
    n = blocks or max(1, -(-small.count() // BLOCK_ROWS))
    schema = _schema(sized) + ", group_id bigint"
    packed = _one_block(small, order, limit, schema) if n == 1 else _blocks(small, order, limit, schema, n)
    large = large.withColumns({"group_id": F.lit(None).cast("bigint"), "is_large": F.lit(True)})
    return packed.withColumn("is_large", F.lit(False)).unionByName(large)


def oversize(sized: DataFrame, limit: int, size: str = "t") -> tuple[DataFrame, DataFrame]:
    """(rows that fit, larger ones); a size equal to the limit fits, a null one too."""
    over = F.coalesce(F.col(size) > limit, F.lit(False))
    return sized.where(~over), sized.where(over)


def _one_block(small: DataFrame, order: list[str], limit: int, schema: str) -> DataFrame:
    """Up to BLOCK_ROWS rows are sorted in one task and packed as they come."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried, group = -1, 0
        for pdf in batches:
            pdf["group_id"], carried, group = next_fit(pdf["t"].tolist(), limit, carried, group)
            yield pdf

    return small.coalesce(1).sortWithinPartitions(*order).mapInPandas(assign, schema)


def _blocks(small: DataFrame, order: list[str], limit: int, schema: str, n: int) -> DataFrame:
    rows = materialize(small.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id().cast("bigint")), "pack-blocks")

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(order, kind="stable", na_position="first")

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        needs, groups, carries, total = summary(ordered(pdf)["t"].tolist(), limit)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "needs": [needs], "groups": [groups], "carries": [carries], "total": [total]})

    summed = materialize(rows.select(*order, "t", "block").groupBy("block").applyInPandas(sum_up, SUMMED), "pack-summaries")
    begins = starts(summed, n, limit)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        carried, group = begins[int(pdf["block"].iloc[0])]
        pdf["group_id"] = next_fit(pdf["t"].tolist(), limit, carried, group)[0]
        return pdf.drop(columns="block")

    return rows.groupBy("block").applyInPandas(assign, schema)


def _schema(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def pack_in_buckets(df: DataFrame, key: str, order: list[str], tokens: Column, limit: int, buckets: int = 64) -> DataFrame:
    """Next-fit within hash buckets of key, for a stage whose input order is free: at most one part-filled group more a
    bucket. Group ids are bucket times 2^40 plus the number within; larger rows become groups of their own."""
    columns = [c for c in df.columns if c not in ("group_id", "is_large", "t", "bucket")]
    sized = df.select(*columns, F.coalesce(tokens.cast("bigint"), F.lit(0)).alias("t"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("bigint").alias("bucket"))
    small = sized.where(F.col("t") <= limit)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", na_position="first")
        pdf["group_id"] = [(int(b) << 40) + g for b, g in zip(pdf["bucket"], next_fit(pdf["t"].tolist(), limit, -1, 0)[0])]
        return pdf.drop(columns="bucket")

    packed = small.groupBy("bucket").applyInPandas(assign, _schema(small, "bucket") + ", group_id bigint").withColumn("is_large", F.lit(False))
    own = F.col("bucket") * F.lit(1 << 40) + F.lit(1 << 39) + F.pmod(F.xxhash64(*order), F.lit(1 << 38))
    large = sized.where(F.col("t") > limit).select(*columns, "t", own.alias("group_id"), F.lit(True).alias("is_large"))
    return packed.unionByName(large)


def with_singletons(packed: DataFrame, order: list[str]) -> DataFrame:
    """Larger rows become groups of their own: negative numbers from the hash of their order, so that they clash with none."""
    own = -1 - F.pmod(F.xxhash64(*order), F.lit(1 << 62))
    return packed.withColumn("group_id", F.when(F.col("is_large"), own).otherwise(F.col("group_id")))
