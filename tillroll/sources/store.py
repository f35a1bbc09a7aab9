"""Files by key under one folder: guarded writes, reads through manifests, fetches of chosen files, and a cache of lines.

Tasks reach files through ``pyarrow.fs``, so the folder's scheme must be one that pyarrow opens.  A file is written under another
name and moved, so a repeated task leaves the same file and never half of one.  A write's manifest is a table that is written last; what no
manifest names isn't there for readers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.privacy import is_image

MANIFEST = "_manifest"
#: An upload's files and bytes a file at most.
UPLOAD_FILES, UPLOAD_BYTES = 30, 10 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    files, at = opened(path)
    return files.get_file_info(at).type != fs.FileType.NotFound


def guarded(key: Column) -> Column:
    """S-06: the key with ``.`` and ``..`` resolved, or null if it is empty, absolute, or leads out of its folder."""
    start = F.struct(F.lit(True).alias("inside"), F.array().cast("array<string>").alias("path"))

    def step(a: Column, part: Column) -> Column:
        up = F.struct((a["inside"] & (F.size(a["path"]) > 0)).alias("inside"), F.slice(a["path"], 1, F.greatest(F.size(a["path"]) - 1, F.lit(0))).alias("path"))
        down = F.struct(a["inside"].alias("inside"), F.concat(a["path"], F.array(part)).alias("path"))
        return F.when(part.isin("", "."), a).when(part == "..", up).otherwise(down)

    done = F.aggregate(F.split(key, "/"), start, step)
    sound = done["inside"] & (F.size(done["path"]) > 0) & ~key.startswith("/") & ~key.contains("\0") & ~key.contains("\\") & (done["path"][0] != MANIFEST)
    return F.when(sound, F.array_join(done["path"], "/"))


def store_files(rows: DataFrame, base: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S-05, S-06: writes ``content`` (bytes) of each ``key`` below ``base``.  Returns (key, bytes, sha256) of what is stored, and (key, reason) of rejected rows.

    Of several rows of one key the last by ``order`` wins, without it the greatest content; null contents are empty files.
    """
    spark = rows.sparkSession
    judged = rows.withColumn("at", guarded(F.col("key")))
    last = F.max_by("content", F.struct(*([order] if order else []), "content"))
    good = judged.filter("at IS NOT NULL").withColumn("content", F.coalesce("content", F.lit(b""))).groupBy(F.col("at").alias("key")).agg(last.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(base)
        for batch in batches:
            out = []
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = f"{root}/{key}"
                aside = f"{path}.{uuid.uuid4().hex}.part"
                files.create_dir(path.rpartition("/")[0], recursive=True)
                with files.open_output_stream(aside) as stream:
                    stream.write(content)
                files.move(aside, path)
                out.append((key, len(content), hashlib.sha256(content).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["key", "bytes", "sha256"])

    at = f"{base}/{MANIFEST}/{uuid.uuid4().hex}"
    good.mapInArrow(run, "key string, bytes bigint, sha256 string").withColumn("written", F.current_timestamp()).write.parquet(at)
    return spark.read.parquet(at).drop("written"), judged.filter("at IS NULL").select("key", F.lit("key leads out of its folder").alias("reason"))


def stored(spark: SparkSession, base: str) -> DataFrame:
    """(key, bytes, sha256) of all files that finished writes name; the latest write of a key counts."""
    if not exists(f"{base}/{MANIFEST}"):
        return spark.createDataFrame([], "key string, bytes bigint, sha256 string")
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/{MANIFEST}")
    return rows.groupBy("key").agg(F.max_by(F.struct("bytes", "sha256"), "written").alias("x")).select("key", "x.*")


def fetched(listing: DataFrame, most: int | None = None) -> DataFrame:
    """``listing`` with the content of each ``path``, and what went wrong instead; a bad file doesn't stop others.

    Files longer than ``most`` bytes aren't read.  Only the listed files are opened.
    """
    columns = listing.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                content = error = None
                try:
                    files, at = opened(path)
                    size = files.get_file_info(at).size
                    if size is None:
                        error = "missing"
                    elif most is not None and size > most:
                        error = "too long"
                    else:
                        with files.open_input_stream(at) as stream:
                            content = stream.read()
                except (OSError, ValueError, TypeError, AttributeError) as problem:
                    error = f"{type(problem).__name__}: {problem}"
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], [*columns, "content", "error"])

    schema = T.StructType([*listing.schema.fields, *T.StructType.fromDDL("content binary, error string").fields])
    return listing.mapInArrow(run, schema)


def read_stored(spark: SparkSession, base: str) -> DataFrame:
    """(key, content, error) of all stored files; a file that isn't what its manifest says has an error instead."""
    rows = fetched(stored(spark, base).withColumn("path", F.concat(F.lit(f"{base}/"), "key")))
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(F.sha2("content", 256) != F.col("sha256"), "changed")
    return rows.select("key", F.when(wrong.isNull(), F.col("content")).alias("content"), wrong.alias("error"))


def ocr_key(tenant: Column, receipt: Column) -> Column:
    return F.concat(F.lit("receipts/"), tenant, F.lit("/"), receipt, F.lit(".txt"))


def store_texts(rows: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """S-05: (tenant_id, receipt_id, lines) as text files, lines joined by a line feed."""
    return store_files(rows.select(ocr_key(F.col("tenant_id"), F.col("receipt_id")).alias("key"), F.encode(F.array_join("lines", "\n"), "UTF-8").alias("content")), base)


def read_texts(spark: SparkSession, base: str) -> DataFrame:
    """S-05: (key, lines) of the stored texts."""
    return read_stored(spark, base).filter("key LIKE 'receipts/%.txt'").select("key", F.split(F.decode("content", "UTF-8"), r"\r\n|\n|\r").alias("lines"))


def upload_batch(spark: SparkSession, folder: str, names: list[str], *, most_files: int = UPLOAD_FILES, most_bytes: int = UPLOAD_BYTES) -> DataFrame:
    """S-16: (place, filename, ok, reason, content) of an upload of some files of a folder, in the order asked for.

    Names come first, contents are fetched for these only.  What isn't an image, is broken, missing or too long is a row with a reason, and
    stops none of the others.
    """
    if not names:
        raise ValueError("no file was chosen")
    if len(names) > most_files:
        raise ValueError(f"at most {most_files} files at a time")
    asked = spark.createDataFrame(list(enumerate(names)), "place int, filename string").repartition(min(len(names), spark.sparkContext.defaultParallelism))
    safe = guarded(F.col("filename"))
    rows = fetched(asked.withColumn("path", F.when(safe.isNotNull(), F.concat(F.lit(f"{folder}/"), safe))), most_bytes)
    image = F.coalesce(is_image(F.col("content")), F.lit(False))
    reason = F.when(F.col("path").isNull(), "key leads out of its folder").when(F.col("error").isNotNull(), F.col("error")).when(~image, "no image")
    return rows.select("place", "filename", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"), F.when(reason.isNull(), F.col("content")).alias("content"))


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, stamp) of a folder's files; contents aren't read.  ``stamp`` is the time of change and the length."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    stamp = F.concat_ws("-", F.unix_micros("modificationTime"), "length")
    return read.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), stamp.alias("stamp"))


def cached_lines(files: DataFrame, compute: Callable[[DataFrame], DataFrame], cache: str, *, fresh: bool = False) -> DataFrame:
    """S-09: (name, stamp, lines) of ``files`` (path, name, stamp), made by ``compute`` from rows with content where the cache has no row of that name and stamp.

    The cache is a table of increments.  An increment is written whole and then named by an empty file in ``_done``, so half an increment is never
    read and two runs at once only do work twice.  Rows of changed or deleted files stay behind and are not found again.
    ``compute`` gives (name, stamp, lines); only lines are kept, what is parsed from them never is.  ``fresh`` makes all rows anew.
    """
    spark = files.sparkSession
    store, root = opened(cache)
    done = [x.base_name for x in store.get_file_info(fs.FileSelector(f"{root}/_done", allow_not_found=True))]
    held = spark.read.schema("name string, stamp string, lines array<string>").parquet(*(f"{cache}/{x}" for x in sorted(done))) if done and not fresh else None
    stale = files.join(held, ["name", "stamp"], "left_anti") if held is not None else files
    version = uuid.uuid4().hex
    compute(fetched(stale)).select("name", "stamp", "lines").write.parquet(f"{cache}/{version}")
    made = spark.read.schema("name string, stamp string, lines array<string>").parquet(f"{cache}/{version}")
    if not made.isEmpty():
        store.create_dir(f"{root}/_done")
        with store.open_output_stream(f"{root}/_done/{version}"):
            pass
    every = made if held is None else held.unionByName(made)
    return files.select("name", "stamp").join(every, ["name", "stamp"]).dropDuplicates(["name", "stamp"])
