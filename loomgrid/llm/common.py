"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the word contracts: space, tab, \n, \v, \f, \r.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Ids that are sent to every executor (8 bytes each); beyond it tables are joined by shuffle.
BROADCAST_IDS = 2_000_000
_LEFT: set[str] = set()
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that an Arrow function gets at once, and of a row group of intermediate tables: both are held whole for each running task.
BATCH_BYTES, GROUP_BYTES = 4 << 20, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Non-empty words between separators; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see; set here only where the session leaves it unset, which a cluster must not."""
    ctx = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or ctx.getCheckpointDir()
    if not base:
        if not ctx.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    if not ctx.getCheckpointDir():
        ctx.setCheckpointDir(base)
    return base


@contextmanager
def batches(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Jobs inside give Arrow functions at most ``BATCH_BYTES``, and ``rows`` rows if named, at once."""
    held = {k: spark.conf.get(k) for k in (_BATCH, _BYTES)}
    spark.conf.set(_BYTES, str(BATCH_BYTES))
    if rows is not None:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def written(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None, batch: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors. ``by``: a column to
    partition its files by; ``batch``: rows that Arrow functions get at once, where rows are large. ``drop`` removes it; tables that are left (results may still read them) go when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_clear, spark)
    _LEFT.add(path)
    writer = df.write.option("compression", codec).option("parquet.block.size", GROUP_BYTES)
    with batches(spark, batch):
        (writer if by is None else writer.partitionBy(by)).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _LEFT.discard(path)


def _clear(spark: SparkSession) -> None:
    if spark._jsc is not None and spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        for path in list(_LEFT):
            _remove(spark, path)


def drop(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read any more."""
    for t in tables:
        _remove(t.sparkSession, t.written_at)


def trim() -> None:
    """Gives memory that Arrow and numpy have freed back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give is not None:
        give(0)


def _trim_java(spark: SparkSession) -> None:
    """The driver's Java gives back what it has freed outside its heap, mostly its compilers' memory; a Java that has no such command keeps it."""
    java, array = spark._jvm, spark.sparkContext._gateway.new_array
    with suppress(Py4JError):
        call = next(m for m in java.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args, name = array(java.Object, 4), java.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[0], args[1], args[2], args[3] = name, "systemTrimNativeHeap", array(java.Object, 0), array(java.String, 0)
        call.invoke(java.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def rest(spark: SparkSession) -> None:
    """The driver gives freed memory back: many small jobs leave plans and code that its heap keeps until it is full."""
    trim()
    spark._jvm.System.gc()
    _trim_java(spark)


def rest_all(spark: SparkSession) -> None:
    """As ``rest``, and the executors too: a heap that earlier work grew stays so large until a full collection, and Python workers need the room."""
    rest(spark)
    ctx = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", ctx.master):  # there the driver's heap is the only one
        slots = ctx.defaultParallelism  # tasks for each core, so that every executor gets some
        for _ in range(2):  # threads hold what their last task read until they get another
            spark.range(0, slots, 1, slots).selectExpr("reflect('java.lang.System', 'gc')").collect()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that trims at its end: Python workers outlive their tasks."""

    def through(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return through


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids, marked for broadcast if it has at most ``most`` rows; beyond it joins shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def ordered_keys(df: DataFrame, id: str, text: str, key: str = "key") -> DataFrame:
    """``df``, written, with a unique long ``key`` that rises with (id, hash of the text), null ids first; equal rows in any order."""
    spark = df.sparkSession
    rows = df.withColumn("_h", F.xxhash64(text)).withColumn("_m", F.monotonically_increasing_id())
    order = [F.col(id).asc_nulls_first(), F.col("_h"), F.col("_m")]  # a third key, so that no number of equal rows shares one range
    dealt = written(spark, rows, "unordered").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return written(spark, dealt.drop("_h", "_m").withColumn(key, F.monotonically_increasing_id()), "ordered")


def distinct_ids(df: DataFrame, id: str) -> bool:
    """Whether no id repeats or is null."""
    most, nulls = df.groupBy(id).count().agg(F.max("count"), F.count_if(F.col(id).isNull())).first()
    return (most or 1) == 1 and not nulls


def running(values: Column, add: Callable[[Column, Column], Column] = lambda a, x: a + x, zero: Column | None = None, levels: int = 2) -> Column:
    """Running totals of an array, in runs of 64 items whose totals are summed in the same way: work stays close to its length."""
    zero = F.lit(0) if zero is None else zero
    fold = lambda a: F.aggregate(a, zero, add)
    if not levels:
        return F.transform(values, lambda _, i: fold(F.slice(values, F.lit(1), i + 1)))
    runs = lambda v: F.transform(F.filter(F.transform(v, lambda _, i: i), lambda i: i % 64 == 0), lambda i: fold(F.slice(v, i + 1, F.lit(64))))
    inner = lambda v, t: F.transform(v, lambda _, i: add(F.when(i < 64, zero).otherwise(F.get(t, (i / 64).cast("int") - 1)), fold(F.slice(v, (i / 64).cast("int") * 64 + 1, i % 64 + 1))))
    return let(values, lambda v: let(let(runs(v), lambda r: running(r, add, zero, levels - 1)), lambda t: inner(v, t)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
