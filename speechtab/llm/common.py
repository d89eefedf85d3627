"""Shared helpers: table access, the shared work folder and lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='speechtab-')}"


def work_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local master gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system of a Hadoop path, and the path in it."""
    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a new table in the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*frames: DataFrame) -> None:
    """Deletes the files of tables that ``materialize`` wrote and that nothing reads any more."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(df: DataFrame, keep: list[str], make: Callable[[list[str | None]], list[pa.Array]], fields: str, rows: int = 512) -> DataFrame:
    """The columns ``keep`` of ``df`` and those (``fields``, a schema) that ``make`` gets from the texts of some rows.

    Kept columns pass as Arrow data, so that nulls stay nulls and 64-bit integers stay exact.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), fields])
    n = len(keep)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                made = make(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=names)
        release()

    out = df.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    names = df.sparkSession.createDataFrame([], schema).columns
    return out.mapInArrow(batches, schema)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name`` with underscores before it until no column of ``frames`` is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release() -> None:
    """Gives freed memory of a Python worker back to the system, where the C library can; idle workers then stay small."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def crc32_utf8(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
