"""K-d tree sharding (operator 10), on DataFrame functions only.

Equal texts form one group, which stays together. A group is a point in three metadata dimensions
(log size, source, language; the strings by their hash), weighted by its bytes; below every
coordinate lies a hash of the text, so that points that share a coordinate can still be parted.
A node that holds m leaves is split along its widest dimension at the place nearest to
floor(m / 2) / m of its weight. All nodes of a level are split together: the place is found by six
histograms of 11 bits each (one row per node and bin, so 2,048 of a node at most), never by sorting a
node. Nodes are a table in the shared folder; none of it goes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prefix_sums

DIMENSIONS = ("size", "source", "lang")
_STEP, _PASSES, _BUCKETS = 11, 6, 4096
#: Leaves up to which a table of nodes (a row of about 60 bytes each) is broadcast; with more, the join is shuffled.
MAX_BROADCAST_NODES = 1_000_000


def _groups(docs: DataFrame) -> DataFrame:
    metadata = F.struct("doc_id", "source", "lang")
    found = docs.groupBy("g1", "g2").agg(F.sum("size").alias("weight"), F.min("size").alias("size"), F.min(metadata).alias("m"))
    tail = F.shiftrightunsigned("g1", 32)
    unit = lambda c: F.crc32(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))
    values = {"size": F.floor(F.log2("size") * F.lit(2.0**24)), "source": F.shiftrightunsigned(unit(F.col("m.source")), 2), "lang": F.shiftrightunsigned(unit(F.col("m.lang")), 2)}
    coordinates = [F.shiftleft(F.least(v, F.lit((1 << 30) - 1)).cast("long"), 32).bitwiseOR(tail).alias(f"x_{d}") for d, v in values.items()]
    return found.select("g1", "g2", "weight", *coordinates)


def _at(dim: Column) -> Column:
    return F.element_at(F.array(*(F.col(f"x_{d}") for d in DIMENSIONS)), dim + 1)


def _split(points: DataFrame, asked: DataFrame, known) -> DataFrame:
    """node, leaves, dim and cut (the largest coordinate of the left part) of the nodes asked (node, leaves) that have points. known: a hint for joins with a table of nodes."""
    width = [(F.max(f"x_{d}") - F.min(f"x_{d}")).alias(f"w_{d}") for d in DIMENSIONS]
    wide = points.join(known(asked), "node").groupBy("node", "leaves").agg(F.sum("weight").alias("weight"), *width)
    most = F.greatest(*(F.col(f"w_{d}") for d in DIMENSIONS))
    dim = F.coalesce(*(F.when(F.col(f"w_{d}") == most, F.lit(k)) for k, d in enumerate(DIMENSIONS)))
    want = F.col("weight") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    zero = F.lit(0).cast("long")
    state = materialize(wide.select("node", "leaves", dim.alias("dim"), want.cast("double").alias("want"), zero.alias("low"), zero.alias("before"), zero.alias("upto")), "nodes")
    for step in range(_PASSES):
        shift = _STEP * (_PASSES - 1 - step)
        inside = points.join(known(state.drop("upto")), "node").withColumn("x", _at(F.col("dim")))
        if step:
            inside = inside.where(F.shiftrightunsigned("x", shift + _STEP) == F.shiftrightunsigned("low", shift + _STEP))
        bins = inside.groupBy("node", "leaves", "dim", "want", "before", F.shiftrightunsigned("x", shift).alias("bin")).agg(F.sum("weight").alias("w"))
        in_order = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        summed = bins.withColumn("upto", F.col("before") + F.sum("w").over(in_order))
        # the bin in which the wanted weight is reached
        hit = summed.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("w") < F.col("want")))
        last, state = state, materialize(hit.select("node", "leaves", "dim", "want", F.shiftleft("bin", shift).alias("low"), (F.col("upto") - F.col("w")).alias("before"), "upto"), "nodes")
        discard(last)
    # the last bin is one group (or groups that share a hash): it goes to the side that brings the split nearer
    left = F.col("upto") - F.col("want") <= F.col("want") - F.col("before")
    return state.select("node", "leaves", "dim", F.when(left, F.col("low")).otherwise(F.col("low") - 1).alias("cut"))


def kd_leaves(points: DataFrame, n_leaves: int) -> DataFrame:
    """Adds leaf (0 to n_leaves - 1) to points (weight, x_size, x_source, x_lang, node: 0 for all). A node is named by its first leaf."""
    known = F.broadcast if n_leaves <= MAX_BROADCAST_NODES else lambda df: df
    now, nodes = points, points.select("node").distinct().select("node", F.lit(n_leaves).alias("leaves"))
    for level in range(max(0, n_leaves - 1).bit_length()):
        cuts = _split(now, nodes.where("leaves > 1"), known)
        other = F.col("node") + F.floor(F.col("leaves") / 2).cast("int")
        now = now.join(known(cuts), "node", "left").withColumn("node", F.when(_at(F.col("dim")) > F.col("cut"), other).otherwise(F.col("node"))).drop("leaves", "dim", "cut")
        if level % 4 == 3:
            now = materialize(now, "points")  # joins with four tables of nodes at most
        half = F.floor(F.col("leaves") / 2).cast("int")
        parts = F.array(F.struct(F.col("node"), half.alias("leaves")), F.struct(other.alias("node"), (F.col("leaves") - half).alias("leaves")))
        nodes = nodes.where("leaves = 1").unionByName(cuts.select(F.explode(parts).alias("n")).select("n.*"))
    return now.withColumnRenamed("node", "leaf")


def shard_documents(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text, source, lang).

    Leaves are made until they hold target_bytes on average, or exactly n_shards. size is the
    text's UTF-8 bytes plus 1 (null: 1). Law ``bytes``: shards are near equal in size, as far as
    groups of equal texts, which are never parted, allow; null and empty texts are one group. slot
    counts the rows of a shard from 0 without a gap. grown_shard is null. Extra columns are not
    read. An empty table gives an empty result; with fewer groups than shards some stay empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit("second"), text).alias("g2"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
    )
    slim = materialize(slim, "slim")
    points = materialize(_groups(slim).withColumn("node", F.lit(0)), "points")
    if n_shards is None:
        n_shards = max(1, math.ceil((slim.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    leaves = kd_leaves(points, n_shards).select("g1", "g2", F.col("leaf").alias("shard"))
    rows = slim.join(leaves, ["g1", "g2"]).withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS))).withColumn("_one", F.lit(1).cast("long"))
    placed = prefix_sums(rows, ["shard"], "_bucket", ["doc_id", "g1"], "_one", "_upto")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_upto") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """Writes docs as Parquet, one folder for each shard (docs need unique doc_ids)."""
    docs.join(sharded.select("doc_id", "shard"), "doc_id").write.partitionBy("shard").parquet(path)
