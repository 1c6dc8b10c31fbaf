"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns counts as proven small; at 64 bytes a row that is 13 MB.
BROADCAST_ROWS = 200_000
#: Narrow rows that one task may order.
WINDOW_ROWS = 100_000
#: A key is hot with more than HOT_ROWS rows and more than a HOT_KEYS-th of all rows, so at most HOT_KEYS keys are hot.
HOT_ROWS, HOT_KEYS = 2048, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local master may fall back to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints/packloom"


_SCOPES: list[scratch] = []
_RUNS: set[str] = set()


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, or None where the session has no JVM of its own."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def run_dir(spark: SparkSession) -> str:
    """This application's folder inside the shared one; the driver deletes it when its JVM ends in order."""
    path = f"{shared_dir(spark)}/packloom-{spark.sparkContext.applicationId}"
    if path not in _RUNS and (found := hadoop(spark, path)):
        fs, at = found
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _RUNS.add(path)
    return path


def discard(spark: SparkSession, path: str | None) -> None:
    """Delete a stashed table."""
    if path and (found := hadoop(spark, path)):
        found[0].delete(found[1], True)


class scratch:
    """``with scratch(spark) as block``: deletes the tables stashed inside when the block ends, but for those stashed
    with ``outer`` and those that ``block.take()`` names. What leaves the block must not read the others any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> scratch:
        _SCOPES.append(self)
        return self

    def __exit__(self, *_) -> None:
        _SCOPES.remove(self)
        for path in self.paths:
            discard(self.spark, path)

    def take(self) -> str:
        """The path of the table stashed last, which the block then leaves alone."""
        return self.paths.pop()


def stash(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return a reader of it.

    Unlike a persisted table this survives the loss of any executor, and unlike a row checkpoint it stays
    columnar and carries sizes that adaptive execution can check before it broadcasts. It lasts until the innermost
    ``scratch`` block ends, with ``outer`` the next one outside, and without any until the driver ends.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/stash-{uuid.uuid4().hex}"
    if len(_SCOPES) > outer:
        _SCOPES[-1 - outer].paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the counted ``rows`` are within ``limit``; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which holds each key once and in ``size`` how many of ``total`` rows have it.

    Rows of hot keys stay where they are and read their keys' lookup rows from a broadcast of at most ``HOT_KEYS`` rows;
    the others meet theirs in a shuffle. ``lookup`` should be a stashed table, as it is read twice.
    """
    hot = lookup.filter(F.col(size) > max(HOT_ROWS, total // HOT_KEYS))
    if total <= HOT_ROWS or hot.isEmpty():
        return rows.join(lookup, key)
    hot = F.broadcast(hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(lookup, key)
    return rows.join(hot, key).unionByName(cold)


def exclusive_sums(df: DataFrame, key: str, value: str, out: str, partition: list[str] | None = None, fan: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows with a smaller integer ``key``, within ``partition``.

    Three levels: rows in buckets of ``fan`` keys, buckets in super-buckets, and one short list of super-buckets.
    No task sees more than one bucket's rows, whatever the size of the table, so there is no global window, as long as
    keys are dense (row numbers, scaled hashes); ``ranked_sums`` takes any others. ``key`` must be unique within
    ``partition``.
    """
    part = partition or []
    bucket = F.floor(F.col(key) / fan).cast("long")
    rows = df.withColumn("_b1", bucket).withColumn("_b2", F.floor(F.col("_b1") / fan).cast("long"))
    low = rows.groupBy(*part, "_b2", "_b1").agg(F.sum(value).alias("_t1"))
    high = low.groupBy(*part, "_b2").agg(F.sum("_t1").alias("_t2"))

    def before(what: str, by: list[str], order: str) -> Column:
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(w), F.lit(0))

    high = high.withColumn("_o2", before("_t2", part, "_b2")).drop("_t2")
    low = low.withColumn("_o1", before("_t1", [*part, "_b2"], "_b1")).drop("_t1")
    low = low.join(high, [*part, "_b2"]).select(*part, "_b1", (F.col("_o1") + F.col("_o2")).alias("_o"))
    out_rows = rows.drop("_b2").withColumn("_o0", before(value, [*part, "_b1"], key))
    return out_rows.join(low, [*part, "_b1"]).withColumn(out, F.col("_o") + F.col("_o0")).drop("_b1", "_o", "_o0")


def ranked_sums(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows before a row in the order of the ``order`` columns, which no two rows
    share. Keys of any type and spacing: rows are dealt into ranges, each range is summed alone and shifted by the sums
    of the ranges before, of which there are as many as tasks. ``df`` should be narrow, as it is stashed once. Up to
    ``WINDOW_ROWS`` counted rows one ordered window does it.
    """
    df = stash(df)
    if df.count() <= WINDOW_ROWS:
        whole = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(whole), F.lit(0)))
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranged = stash(ranged)
    sums = ranged.groupBy("_p").agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(F.broadcast(before), "_p").withColumn(out, F.col(out) + F.col("_o")).drop("_p", "_o")
