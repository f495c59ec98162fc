"""Arrow-batched maps, and writing a stage once so that nothing runs twice or is lost with an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch may carry to a Python worker. Texts reach 200,000 characters, so rows alone bound nothing.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(key, str(value))


#: Tables of fewer bytes than this are spread over the cores where they have fewer files than there are cores.
SMALL_TABLE = 256 << 20


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """The Parquet table of a folder. spread: for work in Python, which the few files of a small table would leave to a few
    cores; larger tables have files enough and are never shuffled for it. Filters and columns still reach the scan."""
    tune(spark)
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p)
        if size.getFileCount() < cores and size.getLength() < SMALL_TABLE:
            df = df.repartition(cores)
    return df


def arrow_map(df: DataFrame, per_batch: Callable[[dict[str, list]], Iterable[tuple]] | None, schema: str, setup: Callable[[], Callable] | None = None) -> DataFrame:
    """Narrow map: per_batch gets the columns of one Arrow batch as lists and gives output rows in the schema's order.

    setup, if given, runs once in each worker and returns the per_batch to use."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup() if setup else per_batch
        for batch in batches:
            rows = list(work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _local_root() -> str:
    """For tests and single machines; gone when the process ends."""
    root = tempfile.mkdtemp(prefix="sievewright-")
    atexit.register(shutil.rmtree, root, True)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place under the folder that all executors share; a local one only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


_written: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete the stages that this process has written; what reads them must have ended."""
    while _written:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: cuts the lineage, and a lost executor takes nothing with it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
