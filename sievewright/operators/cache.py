"""The keyed cache of answers: an append-only table, read with the last writer winning."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CACHE


def cache_key(messages: Column, model: Column) -> Column:
    """SHA-256 of the JSON of messages and model; a null model counts as an empty one."""
    return F.sha2(F.to_json(F.struct(messages.alias("messages"), F.coalesce(model, F.lit("")).alias("model"))), 256)


def payload(answer: Column) -> Column:
    return F.to_json(F.struct(answer.alias("answer")))


def answer_of(response: Column) -> Column:
    """The answer of a stored payload; null where it is no valid JSON object with one."""
    return F.from_json(response, "answer string", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})["answer"]


def last_wins(rows: DataFrame, key: str = "cache_key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The latest response of each key, combined map side before the shuffle, so that a hot key costs a row a partition."""
    values = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return rows.groupBy(key).agg(newest).select(key, *[F.col(f"v.{c}").alias(c) for c in values])


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key is stored, with the stored response. The cache must hold a key once (see last_wins)."""
    return requests.join(cache.select("cache_key", "response"), "cache_key")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti")


def once_each(requests: DataFrame, partitions: int | None = None) -> DataFrame:
    """One request for each key, so that equal ones are asked once. partitions: as many, by key, with the one shuffle that this takes."""
    if partitions:
        requests = requests.repartition(partitions, "cache_key")
    return requests.dropDuplicates(["cache_key"])


def store_answers(path: str, rows: list[tuple[str, str]]) -> None:
    """Append (key, answer) rows to a cache's folder from a worker, as one file that appears when it is whole."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    now, name = time.time_ns(), f"part-{uuid.uuid4().hex}.parquet"
    stored = pa.table(
        {
            "cache_key": pa.array([k for k, _ in rows], pa.string()),
            "response": pa.array([json.dumps({"answer": a}, ensure_ascii=False, separators=(",", ":")) for _, a in rows], pa.string()),
            "ts": pa.array([now // 1000] * len(rows), pa.timestamp("us", tz="UTC")),
            "seq": pa.array(range(now, now + len(rows)), pa.int64()),
        }
    )
    pq.write_table(stored, f"{root}/.{name}", filesystem=system)
    system.move(f"{root}/.{name}", f"{root}/{name}")


class Cache:
    """A Parquet folder of cache rows. Appends are safe to repeat: a later row of a key hides the earlier one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        before = f"{self.path}-before"
        if not self._exists(self.path) and self._exists(before):  # a delete was broken off between its two moves
            self._move(before, self.path)
        if not self._exists(self.path):
            spark.createDataFrame([], CACHE).write.mode("ignore").parquet(self.path)
        self._remove(before)

    def _file(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        system, p = self._file(path)
        return system.exists(p)

    def _move(self, path: str, to: str) -> None:
        system, p = self._file(path)
        if not system.rename(p, self._file(to)[1]):
            raise OSError(f"{path} could not be moved to {to}")

    def _remove(self, path: str) -> None:
        system, p = self._file(path)
        system.delete(p, True)

    @property
    def direct(self) -> bool:
        """Whether workers can write to the folder themselves."""
        from pyarrow import fs

        try:
            fs.FileSystem.from_uri(self.path)
        except Exception:  # noqa: BLE001 - another scheme, or a library that isn't here
            return False
        return True

    def all_rows(self) -> DataFrame:
        return self.spark.read.schema(CACHE).parquet(self.path)

    def rows(self) -> DataFrame:
        return last_wins(self.all_rows())

    def upsert(self, rows: DataFrame) -> None:
        """rows: cache_key and response. Only answers that are complete and not blank should come here."""
        stamped = rows.select("cache_key", "response", F.current_timestamp().alias("ts"), F.monotonically_increasing_id().alias("seq"))
        stamped.write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame) -> None:
        """Writes what is left beside the folder and then takes its place; readers of the old files must have ended. Broken off
        at any point, it leaves the rows as they were or as they should be."""
        beside, before = f"{self.path}-rewritten", f"{self.path}-before"
        self.rows().join(keys.select("cache_key"), "cache_key", "left_anti").write.mode("overwrite").parquet(beside)
        self._remove(before)
        self._move(self.path, before)
        self._move(beside, self.path)
        self._remove(before)
