"""Interval joins, merges and as-of joins.

A range join gets an equality by bins: the wider side is exploded to the bins it touches, and a pair
is given in the bin of its larger start only, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import bucketed, islands, running


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


#: Tasks for each shuffle partition of the session, where the pairs of a join are many and its rows few.
TASKS_EACH = 4


def dealt(df: DataFrame, *keys) -> DataFrame:
    """df by keys in a number of tasks that AQE keeps: it would put keys together by the size of their rows, which does not tell how many pairs they make."""
    return df.repartition(TASKS_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 16384, how: str = "inner", reach: int = 0, many: bool = False) -> DataFrame:
    """Pairs whose closed intervals (l_start, l_end of left; r_start, r_end of right) meet, or lie up to reach apart.

    Columns other than keys must differ. how: inner, left_semi or left_anti (on all columns of left). many: rows make many pairs, so keys are dealt to tasks.
    """
    a = left.withColumn("_b", F.explode(_bins(F.col("l_start") - reach, F.col("l_end") + reach, width)))
    b = right.withColumn("_b", F.explode(_bins(F.col("r_start"), F.col("r_end"), width)))
    meets = (F.col("l_start") - reach <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end") + reach)
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_b"]})
    if many and how == "inner":
        a, b = dealt(a, *keys, "_b"), dealt(b, *(f"_r_{k}" for k in [*keys, "_b"]))
    equal = a["_b"] == b["_r__b"]
    for k in keys:
        equal &= a[k] == b[f"_r_{k}"]
    if how in ("left_semi", "left_anti"):
        # a row may sit in several bins: name it, find the names, then keep or drop by name
        named = left.withColumn("_id", F.monotonically_increasing_id())
        a = named.withColumn("_b", F.explode(_bins(F.col("l_start") - reach, F.col("l_end") + reach, width)))
        equal = a["_b"] == b["_r__b"]
        for k in keys:
            equal &= a[k] == b[f"_r_{k}"]
        found = a.join(b, equal & meets, "left_semi").select("_id").distinct()
        return named.join(found, "_id", how).drop("_id")
    once = F.col("_b") == F.greatest(F.floor((F.col("l_start") - reach) / width), F.floor(F.col("r_start") / width))
    return a.join(b, equal & meets & once).drop("_b", *(f"_r_{k}" for k in [*keys, "_b"]))


def containment_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 16384) -> DataFrame:
    """Pairs where right's interval holds left's."""
    return overlap_join(left, right, keys, width).where("r_start <= l_start and l_end <= r_end")


def contained(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left that lie inside an interval of right (each once): the largest end among right's starts up to a row's start tells, so the work grows with the rows and not with the pairs."""
    ends = right.where("r_start is not null").groupBy(*keys, F.col("r_start").alias("_at")).agg(F.max("r_end").alias("_end")).withColumn("_side", F.lit(0))
    asked = left.where("l_start is not null").select(*keys, F.col("l_start").alias("_at")).distinct().withColumn("_side", F.lit(1))
    swept = running(bucketed(ends.unionByName(asked, allowMissingColumns=True), "_at"), keys, ["_at", "_side"], "_end", "_most", "max")
    found = swept.where("_side = 1").select(*keys, F.col("_at").alias("l_start"), "_most")
    return left.join(found, [*keys, "l_start"]).where(F.col("l_end") <= F.col("_most")).select(*left.columns)


def sites_left(queries: DataFrame, sites: DataFrame, reach: int) -> DataFrame:
    """Sites (chrom_id, left, right) whose right flank lies in [at + 1 - reach, at] of queries (chrom_id, at)."""
    q = queries.withColumn("l_start", F.col("at") + 1 - reach).withColumn("l_end", F.col("at"))
    s = sites.withColumn("r_start", F.col("right")).withColumn("r_end", F.col("right"))
    return overlap_join(q, s, ["chrom_id"], max(1, reach)).drop("l_start", "l_end", "r_start", "r_end")


def sites_right(queries: DataFrame, sites: DataFrame, reach: int) -> DataFrame:
    """Sites whose left flank lies in [at, at + reach - 1]."""
    q = queries.withColumn("l_start", F.col("at")).withColumn("l_end", F.col("at") + reach - 1)
    s = sites.withColumn("r_start", F.col("left")).withColumn("r_end", F.col("left"))
    return overlap_join(q, s, ["chrom_id"], max(1, reach)).drop("l_start", "l_end", "r_start", "r_end")


def any_site(queries: DataFrame, sites: DataFrame, width: int = 16384) -> DataFrame:
    """queries (chrom_id, l1, r1, l2, r2) for which a site has its left flank in [l1, r1] and its right flank in [l2, r2]."""
    named = queries.withColumn("_id", F.monotonically_increasing_id())
    q = named.withColumn("l_start", F.col("l1")).withColumn("l_end", F.col("r1"))
    s = sites.select("chrom_id", "right", F.col("left").alias("r_start"), F.col("left").alias("r_end"))
    found = overlap_join(q, s, ["chrom_id"], width).where("right between l2 and r2").select("_id").distinct()
    return named.join(found, "_id", "left_semi").drop("_id")


def prefix_max_ends(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds max_end: the largest end among the intervals (start, end) up to and with this one, by start; it bounds backward scans."""
    return running(bucketed(intervals, "start"), keys, ["start", "end"], "end", "max_end", "max").drop("_bucket")


def merge(intervals: DataFrame, keys: list[str], gap: int = 0, carried: dict[str, Column] | None = None) -> DataFrame:
    """Merged intervals (keys, start, end, n, carried aggregates): closed intervals that start at most gap past the end of what came before belong together."""
    marked = islands(intervals, keys, ["start", "end"], "start", "end", gap)
    out = marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), *((c.alias(k)) for k, c in (carried or {}).items()))
    return out.drop("_island")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, value: list[str]) -> DataFrame:
    """Adds value columns of the row of right with the largest start at or below at (null if none); rows without ties in start."""
    names = left.columns
    told = F.struct(F.col(start).alias("_start"), *value)
    a = left.select("*", F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(told.alias("t")).schema["t"].dataType).alias("_told"))
    b = right.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), told.alias("_told"))
    both = a.unionByName(b, allowMissingColumns=True)
    swept = running(bucketed(both, "_at"), keys, ["_at", "_side"], "_told", "_last", "last").where("_side = 1")
    return swept.select(*names, *(F.col("_last")[v].alias(v) for v in value))


def to_chromosome(places: DataFrame, stretches: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(joined, len) of the joined text -> adds chrom_id and pos; places that leave their stretch are dropped."""
    p = places.withColumn("l_start", F.col("joined")).withColumn("l_end", F.col("joined") + F.col("len") - 1)
    s = stretches.select(F.col("chrom_id"), F.col("tstart").alias("_t"), F.col("joined_start").alias("r_start"), (F.col("joined_start") + F.col("len") - 1).alias("r_end"))
    found = overlap_join(p, s, [], width).where("r_start <= l_start and l_end <= r_end")
    return found.withColumn("pos", F.col("_t") + F.col("joined") - F.col("r_start")).drop("l_start", "l_end", "r_start", "r_end", "_t")


def near_pairs(places: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """(keys, id_a, id_b, apart) of places (keys, id, pos) at most distance apart, id_a < id_b."""
    a = places.select(*keys, F.col("id").alias("id_a"), F.col("pos").alias("pos_a"), F.col("pos").alias("l_start"), F.col("pos").alias("l_end"))
    b = places.select(*keys, F.col("id").alias("id_b"), F.col("pos").alias("pos_b"), F.col("pos").alias("r_start"), F.col("pos").alias("r_end"))
    return overlap_join(a, b, keys, max(1, distance), reach=distance).where("id_a < id_b").select(*keys, "id_a", "id_b", F.abs(F.col("pos_a") - F.col("pos_b")).alias("apart"))
