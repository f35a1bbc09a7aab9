"""Session, scratch-table and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is set, in local mode only.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(found)  # a running session refuses to set the key
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, which cuts its lineage, and the table's path."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders that no later step reads."""
    for path in paths:
        files, folder = fs.FileSystem.from_uri(path)
        files.delete_dir(folder)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds Arrow batches by bytes, where the session doesn't: 10,000 long texts are much memory in the JVM and in a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) > most:
        spark.conf.set(name, str(most))


def with_fields(held: Iterable[T.StructField], ddl: str) -> T.StructType:
    """A schema of fields that exist, whatever their names are, and of new ones."""
    return T.StructType([*held, *T.StructType.fromDDL(ddl).fields])


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose ``column`` holds about ``most`` bytes (``rows`` rows at most)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and (total + n > most or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield batch.slice(begin)
