"""The smaller relational operators of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sample_exactly(df: DataFrame, n: int | None, seed: int, key: str) -> DataFrame:
    """Exactly n rows without replacement, the same for the same seed; all of them where n is none, 0 or not less than all."""
    if not n:
        return df
    mix = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(mix, key).limit(n)


def survivors(answers: DataFrame, members: DataFrame, group: str, path: str = "path", answer: str = "answer") -> DataFrame:
    """Members whose path stands anywhere in their group's answer; groups are small, as they are packed to a budget."""
    return members.join(answers.select(group, answer), group).where(F.contains(answer, path))


def sorted_concat(df: DataFrame, key: str, text: str, budget: int | None = None, between: str = "\n\n", salts: int = 32) -> DataFrame:
    """key and the texts of each key, sorted and joined. With a budget of characters only what can reach the result is
    gathered: first within each salt of a key, then within the key, so that a hot key never lies whole in one task."""
    rows = df.select(key, text).where(F.col(text).isNotNull())
    if budget is not None:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(text), F.lit(salts)))
        for part in ([key, "salt"], [key]):
            w = Window.partitionBy(*part).orderBy(text).rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumn("before", F.coalesce(F.sum(F.length(text) + len(between)).over(w), F.lit(0))).where(F.col("before") < budget).drop("before")
        rows = rows.drop("salt")
    joined = F.array_join(F.array_sort(F.collect_list(text)), between)
    return rows.groupBy(key).agg((joined if budget is None else F.substring(joined, 1, budget)).alias(text))


def ordered_concat(df: DataFrame, key: str, order: list[str], text: Column, between: str = "") -> DataFrame:
    """key and the texts of each key joined in the given order; for groups that are bounded by a budget."""
    items = F.array_sort(F.collect_list(F.struct(*order, text.alias("x"))))
    return df.groupBy(key).agg(F.array_join(F.transform(items, lambda s: s["x"]), between).alias("text"))


def placed(spans: DataFrame, key: str = "path") -> DataFrame:
    """Spans with their place within the key, from 1, in order of start, end and type; equal ones in any order."""
    return spans.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "type")))


def not_within(spans: DataFrame, keep: Column, key: str = "path") -> DataFrame:
    """Spans that lie in none of the others that keep marks, by one window instead of a join of intervals: in order of start
    (longer first) a span is inside another exactly if an earlier marked one reaches its end or beyond."""
    w = Window.partitionBy(key).orderBy("start", F.desc("end"), F.desc("type")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(keep, F.col("end"))).over(w)
    return spans.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("reach") < F.col("end"))).drop("reach")
