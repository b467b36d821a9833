"""What the operators share: column hygiene, worker caches, hold-out splits, materialisation."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import time
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session as _session

checkpoint_folder = _session.checkpoint_folder
cut_lineage = _session.cut_lineage
table = _session.table

#: Rows of an Arrow batch: small enough for texts of a megabyte each.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows, as one text may be very long, and sends this package to the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    _session.ship_package(spark)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker; holds caches only, never results."""
    name = "_tessera_worker_state"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.state = {}
        sys.modules[name] = module
    return sys.modules[name].state


def trim_memory() -> None:
    """Gives memory that a task has freed back to the system, as Python workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One output batch for each input batch, in Arrow."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield fn(batch)
        trim_memory()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """The strings of a column as UTF-8, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def hash_sample(df: DataFrame, n: int, size: int, *keys: str) -> DataFrame:
    """The rows whose key hash lies below size / n of its range: ``size`` rows on average out of ``n``, all of them if there are fewer.

    Needs no sort and sends nothing to the driver; the same keys are chosen however rows are dealt out.
    """
    if n <= size:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int((1 << 40) * (size / n)))


def written(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared checkpoint folder and reads it back.

    Cuts lineage as checkpoint() does, but keeps column pruning and compresses; survives lost executors. Tables that are not
    dropped before go when the driver's Python ends.
    """
    path = f"{checkpoint_folder(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    back = spark.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    _left[path] = spark
    return back


#: Tables written and not dropped yet.
_left: dict[str, SparkSession] = {}


def _drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Removes a table made by ``written`` once nothing reads it."""
    _drop(spark, df._tessera_path)
    _left.pop(df._tessera_path, None)


@atexit.register
def _drop_left() -> None:
    """At the driver's end; a session that has stopped already can't delete any more."""
    for path, spark in _left.items():
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):
                _drop(spark, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, and gives the driver's freed memory back; on a cluster, listeners may hold the last file for a moment."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if not spark.sparkContext.master.startswith("local["):
        time.sleep(0.3)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    trim_memory()


def repeated_ids(docs: DataFrame) -> bool:
    """Whether an id repeats or is null, so that rows must be told apart by their texts."""
    many = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    return many.where("count > 1 or doc_id is null").limit(1).count() > 0
