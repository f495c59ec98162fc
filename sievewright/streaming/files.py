"""Files that keep arriving: each micro-batch is searched and its contexts appended. Not in a batch search's scope, but the
same stages; the cache makes a repeated micro-batch cheap and its answers the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parseable, universal_newlines


def file_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", str(files_a_trigger)).load(folder)
    path = F.regexp_replace("_metadata.file_path", "^file:/*", "/")
    return rows.select(path.alias("path"), F.lit(0).cast("bigint").alias("ord"), universal_newlines(F.col("value")).alias("text")).withColumn("parseable", parseable(F.col("path")))


def search_stream(files: DataFrame, run, sink: str, checkpoint: str):
    """run: files -> contexts. One folder a micro-batch, overwritten if it is run again, so each counts once."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            run(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
