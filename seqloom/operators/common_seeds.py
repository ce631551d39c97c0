"""Reads whose seeds are too common to be looked up one by one: an index of two levels.

The reference's places of common k-mers are merged into stretches, cut into pieces, and pieces with
the same bases become one sequence of the first level, however many copies it has. Reads with common
seeds are placed on those sequences, without a cap; the second level gives some of the copies of each
(they tie: the read is the same on all of them), which ones by a hash of the read. The places are then
extended on the reference itself like all other candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import window_rows
from ..sources.scratch import written
from .index import OVERLAP, bases_at
from .intervals import merge

#: Bases of a piece besides the overlap of one read, and buckets over which the copies of a piece are numbered.
PIECE, BUCKETS = 4096, 64


def common_kmers(index: DataFrame, max_hits: int) -> DataFrame:
    """(kmer) of the k-mers with more places than max_hits."""
    return index.groupBy("kmer").agg(F.count("*").alias("_n")).where(F.col("_n") > max_hits).select("kmer")


def repeated_pieces(ref: DataFrame, index: DataFrame, common: DataFrame, k: int, longest: int, bases: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct pieces (chrom_id: their number, seq, copies), and all their places (piece, number, chrom_id, pos), numbered from 0 within a piece. Pieces overlap by the longest read."""
    at = index.join(common, "kmer", "left_semi").select("chrom_id", F.col("pos").alias("start"), (F.col("pos") + k - 1).alias("end"))
    runs = merge(at, ["chrom_id"])
    cut = runs.select("chrom_id", "end", F.explode(F.sequence(F.col("start"), F.col("end"), F.lit(PIECE).cast("long"))).alias("pos"))
    cut = cut.withColumn("_len", F.least(F.lit(PIECE + longest), F.col("end") + 1 - F.col("pos")))
    pieces = written(bases_at(cut, ref, "pos", "_len", "seq", longest=max(OVERLAP, PIECE + longest), bases=bases).select("chrom_id", "pos", "seq"), "pieces")
    distinct = written(pieces.groupBy("seq").agg(F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("chrom_id"), "seq", "copies"), "distinct-pieces")
    places = pieces.join(distinct.select(F.col("chrom_id").alias("piece"), "seq"), "seq").select("piece", "chrom_id", "pos", F.pmod(F.xxhash64("chrom_id", "pos"), F.lit(BUCKETS)).alias("_b"))
    # a piece may have any number of copies: each bucket is numbered on its own, behind the ones before it
    before = Window.partitionBy("piece").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = places.groupBy("piece", "_b").agg(F.count("*").alias("_n")).select("piece", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("piece", "_b").orderBy("chrom_id", "pos")
    numbered = places.join(starts, ["piece", "_b"]).select("piece", (F.col("_first") + F.row_number().over(inside) - 1).alias("number"), "chrom_id", "pos")
    return distinct, written(numbered, "piece-places")


def with_common(stranded: DataFrame, common: DataFrame, k: int) -> DataFrame:
    """The stranded reads (rdid, mate, fw, s, ...) that have a common k-mer."""
    grams = window_rows(stranded, ["rdid", "mate", "fw"], "s", k).join(common, "kmer", "left_semi").select("rdid", "mate", "fw").distinct()
    return stranded.join(grams, ["rdid", "mate", "fw"], "left_semi")


def spread(found: DataFrame, pieces: DataFrame, places: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Candidates (rdid, mate, fw, chrom_id, diagonal) on the reference of alignments found on pieces (chrom_id: the piece, pos): most of a piece's copies for each, neighbours in their numbers from a hash of the read on."""
    j = found.select("rdid", "mate", "fw", F.col("chrom_id").alias("piece"), F.col("pos").alias("_at")).distinct().join(pieces.select(F.col("chrom_id").alias("piece"), "copies"), "piece")
    first = F.pmod(F.xxhash64(F.lit(seed), "rdid", "mate", "fw"), F.col("copies"))
    j = j.withColumn("_first", first).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(most).cast("long"), F.col("copies")) - 1)))
    j = j.withColumn("number", (F.col("_first") + F.col("_i")) % F.col("copies"))
    return j.join(places, ["piece", "number"]).select("rdid", "mate", "fw", "chrom_id", (F.col("pos") + F.col("_at")).alias("diagonal")).distinct()
