"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and everything runs in one process (tests) is a temporary folder taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The lineage ends there: a lost executor costs no recomputation of what
    lies before, and rows that depend on their order in a scan are fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliospark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    release()
    settle(spark)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends: results are lazy, so what they read cannot go before."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_cut(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            folder = name.rpartition("/")[0]
            if "/foliospark/" in folder:
                drop_folder(df.sparkSession, folder)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet: ``name``, or with more underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def one_of_each(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Of the rows of each key the first in order; a key may have most rows.

    Rows are numbered within their partition first, so no task holds more of
    a key than one partition had, and then the partitions' firsts are.
    """
    part, nth = free_name(df, "_part"), free_name(df, "_nth")
    first = lambda rows, *by: rows.withColumn(nth, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(nth) == 1).drop(nth)
    return first(first(df.withColumn(part, F.spark_partition_id()), *keys, F.col(part)).drop(part), *keys)


def whole_order(df: DataFrame) -> list[Column]:
    """An order of rows by all columns that can be ordered."""
    return [F.col(f"`{c}`") for c, kind in df.dtypes if not any(x in kind for x in ("map<", "variant"))]


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 8 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of a text or binary column, and ``rows`` rows, at most; a row alone may be larger."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        n = max(1, min(upto - at, rows))
        yield batch.slice(at, n)
        at += n


def release() -> None:
    """Give freed memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Seconds between two requests of ``settle``, at least, and when the last one was.
SETTLE_SECONDS = 5.0
_settled = float("-inf")


def settle(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage, so that Spark lets go what finished steps have left.

    Spark's cleaner drops broadcasts (on executors too) and shuffle files only
    once the driver's JVM has found that nothing refers to them, which by
    default it is asked for every half hour. What is still referred to stays.
    """
    global _settled
    if time.monotonic() - _settled >= SETTLE_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _settled = time.monotonic()


#: The setting by which Spark ends an Arrow batch, and the bytes it gets where the session has none.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of about ``BATCH_BYTES``.

    By Spark's default a batch has 10,000 rows whatever they weigh, which both
    the executor's JVM and its Python worker then hold at once. A byte limit
    that the session sets itself stays; a row alone may be larger. Small
    batches also stay below the size from which the JVM's Arrow buffers come
    in chunks of their own, and workers, which serve further tasks, give back
    what a task has freed.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if it has over this share of the rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 512
#: Bytes of hot keys' rows that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Over how many salts a hot key's rows are dealt where its row is too large to be broadcast.
SALTS = 64


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, width: Column | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row a key) where a key may have most rows.

    ``groups[count]`` is the key's number of rows and ``total`` their sum. Keys
    with over ``HOT_SHARE`` of all rows, 512 at most by that bound, are
    broadcast, so that their rows stay where they are; all others are
    shuffled, none of them larger than a small share of the whole.

    Rows of ``groups`` are of some numbers each, so 512 of them are small;
    where they hold more, ``width`` says their bytes, and hot ones of over
    ``BROADCAST_BYTES`` in all are not broadcast: their rows are dealt over
    ``SALTS`` salts, and the group's row goes to each of them.
    """
    least = max(1.0, total * HOT_SHARE)
    hot = groups.filter(F.col(count) > least)
    cold = groups.filter(F.col(count) <= least)
    keys = F.broadcast(hot.select(key))
    far = rows.join(keys, key, "left_anti").join(cold, key)
    if width is not None and (hot.agg(F.sum(width)).head()[0] or 0) > BROADCAST_BYTES:
        salt = free_name(rows, "_salt")
        dealt = rows.join(keys, key, "left_semi").withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        near = dealt.join(hot.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, salt]).drop(salt)
    else:
        near = rows.join(F.broadcast(hot), key)
    return near.unionByName(far)


def unbroken(c: Column | str) -> Column:
    """A text without ASCII white space; null counts as empty."""
    out = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for w in WHITE:
        out = F.replace(out, F.lit(w), F.lit(""))
    return out
