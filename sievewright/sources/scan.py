"""Scans of path lists and whole files, and the sinks of a search."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import arrow_map
from ..functions.text import parseable, universal_newlines


def path_list(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, ord): a list in memory, or a text file with a path on each line; lines are stripped, empty ones dropped."""
    if isinstance(paths, str):
        rows = spark.read.text(paths).select(F.trim("value").alias("path"), F.monotonically_increasing_id().alias("ord"))
    else:
        rows = spark.createDataFrame([(p.strip(), i) for i, p in enumerate(paths)], "path string, ord bigint")
    return rows.where("path <> ''")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths below a folder that are files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def existing(paths: DataFrame, files: DataFrame) -> DataFrame:
    return paths.join(files.select("path").distinct(), "path", "left_semi")


def missing(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that are no files; each is worth a warning, none ends the run."""
    return paths.join(files.select("path").distinct(), "path", "left_anti")


def whole_files(spark: SparkSession, root: str | list[str], newlines: bool = True) -> DataFrame:
    """(path, text): one row for each file, with line ends made uniform."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"), F.col("value").alias("text"))
    return files.withColumn("text", universal_newlines(F.col("text"))) if newlines else files


def as_files(df: DataFrame, path: str = "file_path", text: str = "text", order: str = "file_id") -> DataFrame:
    """The files stage of a table: path, ord, text, parseable."""
    return df.select(F.col(path).alias("path"), F.col(order).cast("bigint").alias("ord"), universal_newlines(F.col(text)).alias("text"), parseable(F.col(path)).alias("parseable"))


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """Errors as JSON lines; prompts are never among them."""
    errors.select("kind", "message", "path", "cause").write.mode("append").json(path)


LISTED = "path string, ord bigint, text string, problem string"


def read_listed(paths: DataFrame) -> DataFrame:
    """Reads the files of a list (path, ord) where the tasks run, in LISTED's columns: text with uniform line ends, or what is wrong
    with the path: missing, or unreadable. No path is looked at by the driver, and none ends the run. The files must be
    within the workers' reach; a path may be an address such as hdfs://."""

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        from pyarrow import fs

        for path, ord_ in zip(c["path"], c["ord"]):
            try:
                system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                if system.get_file_info(inner).type != fs.FileType.File:
                    yield path, ord_, None, "missing"
                    continue
                with system.open_input_stream(inner) as f:
                    text = f.read().decode()
                yield path, ord_, text.replace("\r\n", "\n").replace("\r", "\n"), None
            except (OSError, ValueError) as e:
                yield path, ord_, None, f"unreadable: {type(e).__name__}: {e}"

    return arrow_map(paths.select("path", "ord"), per_batch, LISTED)
