"""Sessions with settings of their own, written tables with an end of life, and memory given back by Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rackpulse.session import work_path


def derived_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session on the same cluster with ``settings`` besides the settings of ``spark``, which stays as it is."""
    session = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


class WorkTables:
    """Tables in the shared folder that are removed when they are dropped, or at the end of the block unless kept."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> WorkTables:
        return self

    def __exit__(self, *error: object) -> None:
        for _, path in self.paths.values():
            self._remove(path)
        self.paths = {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = work_path(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, table: DataFrame) -> None:
        self._remove(self.paths.pop(id(table))[1])

    def keep(self, *tables: DataFrame) -> None:
        """The tables are read after the block too; the shared folder's owner removes them."""
        for table in tables:
            self.paths.pop(id(table))

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def unused_name(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows and bytes of the batches that a function of a Python worker sees.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of limited size; a single row may be larger."""
    if len(batch) <= 1 or (len(batch) <= BATCH_ROWS and batch.nbytes <= BATCH_BYTES):
        yield batch
    else:
        half = len(batch) // 2
        yield from _bounded(batch.slice(0, half))
        yield from _bounded(batch.slice(half))


def give_back() -> None:
    """The worker's unused memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def in_arrow(run: Callable) -> Callable:
    """``run`` for ``mapInArrow`` with batches of limited rows and bytes, whatever the session's settings are.

    At its end the worker's unused memory goes back to the system: workers serve many tasks, and freed blocks of one would
    count against the executor all the time.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _bounded(batch)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts(batches))
        give_back()

    return bounded
