"""Running sums, maxima and last values over an order, without a task that holds a key.

Rows are cut into buckets of the order by quantiles of its first column. Each bucket is summed up
first (one row for each key and bucket), what the buckets before it hold is carried in, and every
bucket is then swept on its own. So a chromosome that holds all rows is still many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each shuffle partition of the session.
BUCKETS_EACH = 4


def bucketed(df: DataFrame, column: str, buckets: int | None = None, name: str = "_bucket") -> DataFrame:
    """Adds the number of the bucket of a numeric column that the order begins with; equal values share a bucket."""
    n = buckets or BUCKETS_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(found or []))
    return df.withColumn(name, _part(F.col(column), cuts))


def _part(value: Column, cuts: list) -> Column:
    """How many cuts lie below value, searched in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    parts = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    outer = F.size(F.filter(F.array(*(F.lit(p[-1]) for p in parts[:-1])), lambda c: c < value)) if len(parts) > 1 else F.lit(0)
    inner = F.size(F.filter(F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in parts)), outer + 1), lambda c: c < value))
    return F.when(value.isNull(), 0).otherwise(outer * step + inner)


def running(df: DataFrame, keys: list[str], order: list, value: str, out: str, kind: str, inclusive: bool = True, bucket: str = "_bucket") -> DataFrame:
    """Adds out: the running ``sum``, ``max`` or ``last`` (nulls passed over) of value within keys in the order (bucket, *order), with the row itself or without. df has the bucket."""
    ordering = [F.col(c) if isinstance(c, str) else c for c in order]
    whole = {"sum": F.sum(value), "max": F.max(value), "last": F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*(c.alias(f"_{k}") for k, c in enumerate(ordering)))))}[kind]
    pick = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*keys, bucket).agg(whole.alias("_whole")).withColumn("_carried", pick("_whole").over(before)).drop("_whole")
    here = Window.partitionBy(*keys, bucket).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = carried.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate([*keys, bucket])), "_carried")
    same = [df[c].eqNullSafe(own[f"_k{n}"]) for n, c in enumerate([*keys, bucket])]
    joined = df.join(own, same).drop(*(f"_k{n}" for n in range(len(keys) + 1)))
    inside, past = pick(value).over(here), F.col("_carried")
    told = F.coalesce(past, F.lit(0)) + F.coalesce(inside, F.lit(0)) if kind == "sum" else F.greatest(past, inside) if kind == "max" else F.coalesce(inside, past)
    return joined.withColumn(out, told).drop("_carried")


def islands(df: DataFrame, keys: list[str], order: list, start: str, end: str, gap: int = 0, out: str = "_island") -> DataFrame:
    """Adds out: a number for each run of intervals that start at most gap past the largest end before them; order begins with start."""
    cut = running(bucketed(df, start), keys, order, end, "_reach", "max", inclusive=False)
    new = F.coalesce(F.col(start) > F.col("_reach") + gap, F.lit(True)).cast("long")
    return running(cut.withColumn("_new", new), keys, order, "_new", out, "sum").drop("_new", "_reach", "_bucket")
