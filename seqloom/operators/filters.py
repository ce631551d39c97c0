"""Row filters of reads, alignments and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import LengthFunction, Options, Scoring
from ..functions.seq import count_n


def skip_upto(reads: DataFrame, skip: int = 0, upto: int | None = None) -> DataFrame:
    """Reads from number skip on, upto of them."""
    kept = reads.where(F.col("rdid") >= skip)
    return kept if upto is None else kept.where(F.col("rdid") < skip + upto)


def sample(reads: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A share of the reads, by a hash of the read number, so that both mates stay together and reruns agree."""
    return reads.where(F.pmod(F.xxhash64(F.lit(seed), "rdid"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def n_filter(seq: Column, ceiling: LengthFunction = Scoring().n_ceiling) -> Column:
    return count_n(seq) <= ceiling.column(F.length(seq)).cast("long")


def pair_n_filter(reads: DataFrame, ceiling: LengthFunction = Scoring().n_ceiling, concatenated: bool = False) -> DataFrame:
    """Adds n_ok; concatenated: the mates of a pair are judged as one sequence."""
    if not concatenated:
        return reads.withColumn("n_ok", n_filter(F.col("seq"), ceiling))
    w = Window.partitionBy("rdid")
    return reads.withColumn("n_ok", F.sum(count_n(F.col("seq"))).over(w) <= ceiling.column(F.sum(F.length("seq")).over(w)).cast("long"))


def qc_ok(flag: Column) -> Column:
    return F.coalesce(flag != "0", F.lit(True))


def length_ok(seq: Column, least: int = 2) -> Column:
    return F.length(seq) >= least


def score_ok(seq: Column, s: Scoring = Scoring()) -> Column:
    """Whether a perfect alignment could reach the least score."""
    return F.length(seq) * s.match >= s.min_score.whole(F.length(seq))


def strands(reads: DataFrame, nofw: bool = False, norc: bool = False, policy: str = "fr") -> DataFrame:
    """Adds fw, one row for each strand to be searched; the restriction is swapped for the mate that lies on the other strand."""
    out = reads.withColumn("fw", F.explode(F.array(F.lit(True), F.lit(False))))
    swapped = F.col("mate") == 2 if policy in ("fr", "rf") else F.lit(False)
    if nofw:
        out = out.where(F.col("fw") == swapped)
    if norc:
        out = out.where(F.col("fw") != swapped)
    return out


def filtered(reads: DataFrame, o: Options = Options()) -> DataFrame:
    """Adds yf, the reason why a read is not aligned (LN, NS, SC, QC), or null."""
    from ..functions.sam import filter_tag

    seq = F.col("seq")
    qc = qc_ok(F.col("filter")) if o.qc_filter else F.lit(True)
    return reads.withColumn("yf", filter_tag(length_ok(seq), n_filter(seq, o.scoring.n_ceiling), score_ok(seq, o.scoring), qc))


def transcriptome_only(alignments: DataFrame, exons: DataFrame, known: DataFrame) -> DataFrame:
    """Alignments (chrom_id, start, end, junctions) whose junctions are all known, or that lie in one exon."""
    from .intervals import contained

    named = alignments.withColumn("_id", F.monotonically_increasing_id())
    spliced = named.select("_id", "chrom_id", F.explode("junctions").alias("j")).select("_id", "chrom_id", "j.left", "j.right")
    unknown = spliced.join(known.select("chrom_id", "left", "right"), ["chrom_id", "left", "right"], "left_anti").select("_id").distinct()
    within = contained(
        named.where(F.size("junctions") == 0).withColumn("l_start", F.col("start")).withColumn("l_end", F.col("end")), exons.select("chrom_id", F.col("left").alias("r_start"), F.col("right").alias("r_end")), ["chrom_id"]
    )
    return named.where(F.size("junctions") > 0).join(unknown, "_id", "left_anti").unionByName(within.drop("l_start", "l_end")).drop("_id")


def compatible(a: str, b: str) -> Column:
    """Whether variant b (pos, type, len) may follow variant a on one haplotype."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    end = F.when(x("type") == "deletion", x("pos") + x("len")).when(x("type") == "splice", x("pos") + x("len") + 2).otherwise(x("pos"))
    return (x("pos") != y("pos")) & (y("pos") > end)


def compatible_pairs(variants: DataFrame, reach: int) -> DataFrame:
    """(chrom, id_a, id_b) of variants up to reach apart that may stand on one haplotype, a before b."""
    from .intervals import overlap_join

    told = F.struct(*variants.columns)
    a = variants.select("chrom", told.alias("a"), F.col("pos").alias("l_start"), F.col("pos").alias("l_end"))
    b = variants.select("chrom", told.alias("b"), F.col("pos").alias("r_start"), F.col("pos").alias("r_end"))
    # a pair carries what compatible() asks for, so the pairs are not joined with the variants again
    pairs = overlap_join(a, b, ["chrom"], max(1, reach), reach=reach).where(F.struct("a.pos", "a.id") < F.struct("b.pos", "b.id"))
    return pairs.where(compatible("a", "b")).select("chrom", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def pair_orientation(policy: str, one_left: Column, fw1: Column, fw2: Column) -> Column:
    """Whether the strands of two mates fit the policy, given whether mate 1 lies left."""
    wanted = {"ff": (one_left, one_left), "rr": (~one_left, ~one_left), "fr": (one_left, ~one_left), "rf": (~one_left, one_left)}[policy]
    return (fw1 == wanted[0]) & (fw2 == wanted[1])
