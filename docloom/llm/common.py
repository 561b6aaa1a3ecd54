"""Shared plumbing: reading tables, cutting lineage in the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: str | None = None
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the
    session names one; else (single-machine tests only) a temporary folder of our own."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return _LOCAL_ROOT


class Scratch:
    """Tables written to the shared folder, to cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, compression: str = "lz4", **options) -> DataFrame:
        """``df`` written as Parquet and reread; ``.scratch_path`` of the result is its folder."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        writer = df.write.option("compression", compression)
        for k, v in options.items():
            writer = writer.option(k.replace("__", "."), v)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of this scratch that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a step makes of one stays small; at the
    end freed memory goes back, since workers are kept for later tasks."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [v or b"" for v in column.to_pylist()]


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``limit``; a larger row makes a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
