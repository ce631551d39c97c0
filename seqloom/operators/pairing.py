"""Pairs: classes, windows for the other mate, pairing and rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import Options


def pair_class(off1: Column, len1: Column, fw1: Column, off2: Column, len2: Column, fw2: Column, o: Options = Options()) -> Column:
    """NORMAL, OVERLAP, CONTAIN, DOVETAIL or DISCORD for two intervals with strands, by policy and fragment size."""
    same = o.policy in ("ff", "rr")
    one_left = fw1 if o.policy in ("ff", "fr") else ~fw1
    strands = fw1 == fw2 if same else fw1 != fw2
    hi1, hi2 = off1 + len1 - 1, off2 + len2 - 1
    size = F.greatest(hi1, hi2) + 1 - F.least(off1, off2)
    fits = (size <= o.max_fragment) & (size >= max(1, o.min_fragment))
    contain = ((off1 >= off2) & (hi1 <= hi2)) | ((off2 >= off1) & (hi2 <= hi1))
    overlap = (off1 <= hi2) & (off2 <= hi1)
    swapped = F.when(one_left, off2 < off1).otherwise(off1 < off2)
    dovetail = F.when(one_left, (hi1 > hi2) | (off2 < off1)).otherwise((hi2 > hi1) | (off1 < off2))
    ok = lambda allowed, name: F.lit(name if allowed else "DISCORD")
    out = F.when(~strands | ~fits, "DISCORD").when(~overlap & swapped, "DISCORD")
    if not o.overlap:
        out = out.when(overlap, "DISCORD")
    if not o.contain:
        out = out.when(contain, "DISCORD")
    return out.when(dovetail, ok(o.dovetail, "DOVETAIL")).when(contain, "CONTAIN").when(overlap, "OVERLAP").otherwise("NORMAL")


def mate_window(anchor_start: Column, anchor_len: Column, anchor_fw: Column, other_len: Column, anchor_mate: Column, o: Options = Options()) -> tuple[Column, Column, Column]:
    """(first, last, fw): where the other mate's leftmost base may lie, and its strand."""
    same = o.policy in ("ff", "rr")
    fw = anchor_fw if same else ~anchor_fw
    # whether the anchor is the left one of the two
    forward_left = o.policy in ("ff", "fr")
    one = anchor_fw if forward_left else ~anchor_fw
    left = F.when(anchor_mate == 1, one).otherwise(~one if same else (anchor_fw if o.policy == "fr" else ~anchor_fw))
    end = anchor_start + anchor_len
    first = F.when(left, anchor_start).otherwise(end - o.max_fragment)
    last = F.when(left, anchor_start + o.max_fragment - other_len).otherwise(end - other_len)
    return first, last, fw


def concordant_pairs(alns: DataFrame, o: Options = Options(), penalty: float = 0.03) -> DataFrame:
    """(rdid, a, b, score, class) of alignments (rdid, mate, chrom_id, pos, end, fw, len, score) of both mates.

    Same chromosome and policy; with spliced alignment the mates may lie a longest intron apart, without
    it the class must not be DISCORD. A pair stays if it reaches the best pair, or falls short of the
    mates' best scores by at most 6 points in 3 of 100 bases.
    """
    told = F.struct(*(c for c in alns.columns if c != "rdid"))
    a = alns.where("mate = 1").select("rdid", told.alias("a"))
    b = alns.where("mate = 2").select("rdid", told.alias("b"))
    both = a.join(b, "rdid").where("a.chrom_id = b.chrom_id")
    kind = pair_class(F.col("a.pos"), F.col("a.end") - F.col("a.pos") + 1, F.col("a.fw"), F.col("b.pos"), F.col("b.end") - F.col("b.pos") + 1, F.col("b.fw"), o)
    both = both.withColumn("class", kind).withColumn("score", F.col("a.score") + F.col("b.score"))
    if o.spliced:
        same = o.policy in ("ff", "rr")
        strands = (F.col("a.fw") == F.col("b.fw")) if same else (F.col("a.fw") != F.col("b.fw"))
        one_left = F.col("a.fw") if o.policy in ("ff", "fr") else ~F.col("a.fw")
        in_order = F.when(one_left, (F.col("a.pos") <= F.col("b.pos")) & (F.col("a.end") <= F.col("b.end"))).otherwise((F.col("b.pos") <= F.col("a.pos")) & (F.col("b.end") <= F.col("a.end")))
        gap = F.greatest("a.pos", "b.pos") - F.least("a.end", "b.end")
        both = both.where(strands & in_order & (gap <= o.scoring.max_intron))
    else:
        both = both.where("class <> 'DISCORD'")
    best = alns.groupBy("rdid").agg(F.max(F.when(F.col("mate") == 1, F.col("score"))).alias("_b1"), F.max(F.when(F.col("mate") == 2, F.col("score"))).alias("_b2"))
    both = both.join(best, "rdid").withColumn("_best", F.max("score").over(Window.partitionBy("rdid")))
    slack = (F.col("a.len") + F.col("b.len")) * penalty * 6
    return both.where((F.col("score") >= F.col("_best")) & (F.col("score") >= F.col("_b1") + F.col("_b2") - slack)).drop("_b1", "_b2", "_best")


def rescue(anchors: DataFrame, reads: DataFrame, index: DataFrame, k: int, o: Options = Options(), tile: int = 56320) -> DataFrame:
    """Seed hits (rdid, mate, fw, rdoff, chrom_id, pos) of mates that have no alignment, near their anchored mates only.

    anchors: rdid, mate, chrom_id, pos, end, fw. reads: rdid, mate, seq. The join is on tile and k-mer.
    """
    from ..functions.seq import reverse_complement, windows

    lost = reads.join(anchors.select("rdid", "mate"), ["rdid", "mate"], "left_anti").select("rdid", F.col("mate").alias("m"), "seq")
    other = anchors.join(lost, "rdid").where("m <> mate")
    first, last, fw = mate_window(F.col("pos"), F.col("end") - F.col("pos") + 1, F.col("fw"), F.length("seq"), F.col("mate"), o)
    asked = other.select("rdid", F.col("m").alias("mate"), "chrom_id", first.alias("first"), last.alias("last"), fw.alias("fw2"), "seq")
    asked = asked.withColumn("s", F.when(F.col("fw2"), F.col("seq")).otherwise(reverse_complement("seq")))
    spread = asked.select("rdid", "mate", "chrom_id", "first", "last", F.col("fw2").alias("fw"), F.length("seq").alias("n"), F.explode(windows("s", k)).alias("w"))
    grams = spread.select("rdid", "mate", "chrom_id", "first", "last", "fw", F.col("w.kmer").alias("kmer"), F.col("w.pos").alias("rdoff"), F.explode(F.sequence(F.floor(F.col("first") / tile), F.floor((F.col("last") + F.col("n")) / tile))).alias("tile_id"))
    hits = grams.join(index, ["chrom_id", "tile_id", "kmer"]).where("pos - rdoff between first and last")
    return hits.select("rdid", "mate", "fw", "rdoff", "chrom_id", "pos").distinct()


def fragment_length(pairs: DataFrame, bin_width: int = 10) -> DataFrame:
    """(orientation, fraglen, n): pairs (chrom1, pos1, end1, fw1, mapq1, chrom2, ...) with both mates of quality 30, on one chromosome; lengths in bins."""
    good = pairs.where("chrom1 = chrom2 and mapq1 >= 30 and mapq2 >= 30")
    letter = lambda c: F.when(F.col(c), "F").otherwise("R")
    first = F.col("pos1") <= F.col("pos2")
    orientation = F.when(first, F.concat(letter("fw1"), letter("fw2"))).otherwise(F.concat(letter("fw2"), letter("fw1")))
    length = F.greatest("end1", "end2") - F.least("pos1", "pos2") + 1
    return good.groupBy(orientation.alias("orientation"), (F.floor(length / bin_width) * bin_width).alias("fraglen")).agg(F.count("*").alias("n"))
