"""The shared folder of the cluster, and tables written to it."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where none is named, a folder of its own if all runs on one machine; else ValueError, since executors couldn't read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def trim() -> None:
    """Gives freed memory of this worker back to the system, which neither Arrow nor the C library does on their own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


#: Bytes of an Arrow batch, where the session leaves Spark's own limit, which suits narrower rows than texts.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lets Spark hand texts to Python in smaller batches, so that neither side holds much of them at once."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:  # nobody has set it
        spark.conf.set(setting, str(BATCH_BYTES))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a few numbers to a file.
FILE_ROWS = 50_000


def files(rows: int, per: int = FILE_ROWS) -> int:
    """How many files, and tasks, so many rows are worth."""
    return max(1, -(-rows // per))


class Scratch:
    """Tables of one run, written to the shared folder, so that a lost executor costs no more than its tasks.

    ``drop`` frees one at once; what is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.tables: list[str] = []
        bound_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._path(self.root)[0].deleteOnExit(self._path(self.root)[1])

    def _path(self, where: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    @contextmanager
    def _cleaned(self) -> Iterator[None]:
        """What a table is shuffled from goes as soon as it is written."""
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)

    def save(self, frame: DataFrame, name: str, rows: int | None = None, per: int = FILE_ROWS) -> DataFrame:
        """Writes a table and gives it back. ``rows``: about how many it has, if that is known; a file gets ``per`` of them.

        A table of few rows thus becomes few files, however many partitions its last shuffle had; a large one keeps these.
        """
        where = f"{self.root}/{name}"
        if rows is not None:
            frame = frame.coalesce(files(rows, per))
        with self._cleaned():
            frame.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(frame.schema).parquet(where)

    def save_by(self, frame: DataFrame, name: str, column: str, buckets: int, dealt: bool = False) -> DataFrame:
        """Writes a table in so many buckets of ``column``, by which it is grouped or joined later on without a shuffle.

        The catalog of the session knows it until ``forget``; its files are in the shared folder like all others. ``dealt``: whether the
        frame's partitions are so many, by this column, already.
        """
        table = f"{name}_{uuid.uuid4().hex}"
        self.tables.append(table)
        with self._cleaned():
            (frame if dealt else frame.repartition(buckets, column)).write.format("parquet").bucketBy(buckets, column).option("path", f"{self.root}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def forget(self) -> None:
        """Takes the tables of ``save_by`` out of the catalog."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()

    def drop(self, name: str) -> None:
        fs, path = self._path(f"{self.root}/{name}")
        fs.delete(path, True)
