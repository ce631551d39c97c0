"""Splice sites found by earlier reads, for later reads.

Batch: a site is visible to reads whose number exceeds that of the read that found it by a lag. Streaming:
the same rule with state for each chromosome; and running counters of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import bucketed, running

#: Reads that may be in work at once for each thread.
LAG_PER_THREAD = 1000


def lag(threads: int) -> int:
    return 0 if threads <= 1 else LAG_PER_THREAD * threads


def first_found(junctions: DataFrame) -> DataFrame:
    """(chrom_id, left, right, fw, first_rdid) of junctions (rdid, ...)."""
    return junctions.groupBy("chrom_id", "left", "right", "fw").agg(F.min("rdid").alias("first_rdid"))


def visible(queries: DataFrame, sites: DataFrame, threads: int = 1) -> DataFrame:
    """Pairs of queries (rdid, chrom_id, at, reach) and sites within reach of at that the read may see."""
    from ..operators.intervals import overlap_join

    q = queries.withColumn("l_start", F.col("at") - F.col("reach")).withColumn("l_end", F.col("at") + F.col("reach"))
    s = sites.withColumn("r_start", F.col("left")).withColumn("r_end", F.col("left"))
    return overlap_join(q, s, ["chrom_id"]).where(F.col("first_rdid") + lag(threads) <= F.col("rdid")).drop("l_start", "l_end", "r_start", "r_end")


def newest_before(reads: DataFrame, sites: DataFrame, threads: int = 1) -> DataFrame:
    """reads (rdid, chrom_id) with seen: how many sites of the chromosome are visible to each."""
    a = reads.select("rdid", "chrom_id", F.lit(1).alias("side"))
    b = sites.select((F.col("first_rdid") + lag(threads)).alias("rdid"), "chrom_id", F.lit(0).alias("side"))
    both = a.unionByName(b).withColumn("_site", (1 - F.col("side")).cast("long"))
    seen = running(bucketed(both, "rdid"), ["chrom_id"], ["rdid", "side"], "_site", "seen", "sum")
    return seen.where("side = 1").select("rdid", "chrom_id", F.col("seen").cast("long").alias("seen"))


def stream_sites(junctions: DataFrame) -> DataFrame:
    """Streaming: (chrom_id, left, right, fw, first_rdid, num_reads) of a stream of junctions, one row for each site that changed in a batch. The state of a site is its first read and its count."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (None, 0)
        for frame in frames:
            low = int(frame.rdid.min())
            first, n = low if first is None else min(first, low), n + len(frame)
        state.update((first, n))
        yield pd.DataFrame([(*key, first, n)], columns=["chrom_id", "left", "right", "fw", "first_rdid", "num_reads"])

    return junctions.groupBy("chrom_id", "left", "right", "fw").applyInPandasWithState(update, "chrom_id long, left long, right long, fw boolean, first_rdid long, num_reads long", "first_rdid long, num_reads long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, time: str, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Streaming: counts of a stream in windows of event time; what is later than the watermark is left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, object]:
    """df with counters that can be read while and after it runs."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("mapped")).alias("mapped")), o
