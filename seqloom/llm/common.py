"""Helpers that the operators of this subpackage share.

Shared storage: intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``. Only where that setting is absent and Spark runs in one process (tests) a
temporary folder is made; on a cluster the setting is needed. A table written there survives lost
executors and cuts lineage. Tables that nothing reads any more are removed by discard(); the others
feed results that are still to be computed, and release() removes them.
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: dict[str, str] = {}
_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder (with more options of the writer) and reads it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    _written.add(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._path = path
    return table


def discard(table: DataFrame) -> None:
    """Removes a table of materialize() (as that returned it) whose readers are all written."""
    _remove(table.sparkSession, table._path)


def release(spark: SparkSession) -> int:
    """Removes all tables that this process has materialised; results that were not written yet cannot be computed afterwards. How many there were."""
    n = len(_written)
    for path in list(_written):
        _remove(spark, path)
    return n


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While it lasts, Arrow batches hold at most so many rows: whole texts make large batches, which live outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint if df has at most max_rows rows (counted first); else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def column(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(df: DataFrame) -> str:
    """A prefix that no column of df begins with."""
    return "_" * (1 + max(map(len, df.columns), default=0))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; maps count as their JSON."""
    return F.xxhash64(*(F.to_json(F.struct(column(f.name))) if _has_map(f.dataType) else column(f.name) for f in df.schema))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the inclusive running sum of value within keys, in the order (bucket, *order).

    bucket must be monotone in the order, so that no task holds a whole key: the totals of the
    buckets are summed up first (a row per key and bucket), then each bucket is summed on its own.
    Key and bucket columns must not be null.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, [*keys, bucket]).withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before")


def cuts_of(df: DataFrame, column: str, buckets: int) -> list:
    """Ascending values that cut column into about so many equal parts, each to a tenth of a part; fewer if values are hot, none for an empty table."""
    if buckets < 2:
        return []
    found = df.agg(F.percentile_approx(column, [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0]
    return sorted(set(found or []))


def part_of(value: Column, cuts: list) -> Column:
    """How many of the cuts lie below value (null: 0): the number of its bucket. Searched in two steps, so a row costs twice the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    parts = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    # the last cut of each part but the last: which part to look into
    first = F.size(F.filter(F.array(*(F.lit(p[-1]) for p in parts[:-1])), lambda c: c < value)) if len(parts) > 1 else F.lit(0)
    inner = F.size(F.filter(F.element_at(F.array(*(F.array(*(F.lit(c) for c in p)) for p in parts)), first + 1), lambda c: c < value))
    return F.when(value.isNull(), 0).otherwise(first * step + inner).cast("int")
