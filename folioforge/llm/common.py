"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and text contracts: space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local folder is set for a session on one machine (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioforge/{name}-{uuid.uuid4().hex[:12]}"


#: Folders that staged has written and that were not deleted yet.
_WRITTEN: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs a reread."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *stems: str) -> list[str]:
    """A column name for each stem that is not among columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        k = 0
        while (name := f"{stem}{k or ''}").lower() in taken:
            k += 1
        taken.add(name.lower())
        out.append(name)
    return out


#: Most rows of a hot side that is broadcast.
HOT_KEYS = 20_000


def looked_up(rows: DataFrame, of_key: DataFrame, key: str, own: str, count: str, total: int) -> DataFrame:
    """rows with the columns of the one row of of_key where rows' `key` equals its `own` (nulls too); rows without one go.

    `count` says how many of the `total` rows have the key. Keys with more than total / HOT_KEYS of them, of which there
    are fewer than HOT_KEYS, are broadcast, so their rows stay where they are; only the others are shuffled.
    """
    hot = F.col(count) > total // HOT_KEYS
    same = F.col(key).eqNullSafe(F.col(own))
    here = rows.join(F.broadcast(of_key.filter(hot)), same)
    rest = rows.join(F.broadcast(of_key.filter(hot).select(own)), same, "left_anti").join(of_key.filter(~hot), same)
    return here.unionByName(rest)


#: Bits of the filter that tells which rows may have a key of a given set.
FILTER_BITS = 1 << 23


def sieved(rows: DataFrame, hashed: Column, keys: DataFrame) -> DataFrame:
    """rows with `maybe`: false where their `hashed` (a long) is not among keys (column k), true where it is, and for some others.

    The bits are gathered into FILTER_BITS / 64 rows at most, which is what is broadcast.
    """
    slot = F.col("k").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k").bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select("k").groupBy(F.shiftright(slot, 6).alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    own = hashed.bitwiseAND(F.lit(FILTER_BITS - 1))
    has = F.call_function("shiftright", F.col("_bits"), own.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    out = rows.join(F.broadcast(words), F.shiftright(own, 6) == F.col("_w"), "left")
    return out.withColumn("maybe", F.coalesce(has, F.lit(False))).drop("_w", "_bits")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, staged; all that was staged on the way to it is deleted, as nothing reads it any more."""
    mark = len(_WRITTEN)
    out = staged(make(), name)
    gone, _WRITTEN[mark:-1] = _WRITTEN[mark:-1], []
    for path in gone:
        drop_path(spark, path)
    return out


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder of a staged df that nothing reads any more."""
    for path in [p for p in _WRITTEN if any(f.startswith(p.rstrip("/") + "/") for f in df.inputFiles()[:1])]:
        _WRITTEN.remove(path)
        drop_path(spark, path)


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most `most` bytes of that column, a longer value by itself."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def release() -> None:
    """Give free memory of this Python worker back to the machine: workers are used again, by tasks with other needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def collected(spark: SparkSession) -> None:
    """Have the executors collect garbage, so that their heaps shrink to what is in use: what earlier work took is kept else.

    There are as many tasks as cores, one to each free core; an executor that gets none goes on as before. Nothing else depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


#: Rows and bytes of the batches that go to Python, and Spark's own defaults for them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
PLAIN = ("10000", "-1", "-1b", "64MB", str(64 << 20), f"{64 << 20}b", str((1 << 63) - 1), f"{(1 << 63) - 1}b", f"{(1 << 31) - 1}b", str((1 << 31) - 1))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives back the memory it used when its task ends.

    Batches are kept small for the session (they lie in the JVM, in the pipe and in the worker at once), unless it has set them.
    """
    spark = SparkSession.getActiveSession()
    for key, value in BATCHES.items() if spark else ():
        if spark.conf.get(key) in PLAIN:
            spark.conf.set(key, value)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> F.Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str = "text") -> F.Column:
    """Number of words (maximal runs without contract white space); null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")
