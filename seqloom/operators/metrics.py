"""Aggregations over reads, alignments, transcripts and splice sites, and the summary text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .ordered import bucketed
from .ordered import running as swept

#: Read count up to which the distribution of splice-site support is looked at, and the share that sets the cutoff.
SUPPORT_CAP, SUPPORT_SHARE = 100, 0.7


def reporting(reads: DataFrame) -> DataFrame:
    """One row of counters from reads (paired, category, n: alignments of the pair or read, n1, n2: of each mate)."""
    c = F.col
    concord = c("paired") & (c("category") == "concordant")
    unaligned = c("paired") & ~c("category").isin("concordant", "discordant")
    n = F.count_if
    return reads.agg(
        F.count("*").alias("nread"),
        n(c("paired")).alias("npaired"),
        n(~c("paired")).alias("nunpaired"),
        n(c("paired") & ~concord).alias("nconcord_0"),
        n(concord).alias("nconcord_uni"),
        n(concord & (c("n") == 1)).alias("nconcord_uni1"),
        n(concord & (c("n") > 1)).alias("nconcord_uni2"),
        n(c("paired") & (c("category") == "discordant")).alias("ndiscord"),
        (n(unaligned & (c("n1") == 0)) + n(unaligned & (c("n2") == 0))).alias("nunp_0_0"),
        (n(unaligned & (c("n1") == 1)) + n(unaligned & (c("n2") == 1))).alias("nunp_0_uni1"),
        (n(unaligned & (c("n1") > 1)) + n(unaligned & (c("n2") > 1))).alias("nunp_0_uni2"),
        n(~c("paired") & (c("n") == 0)).alias("nunp_0"),
        n(~c("paired") & (c("n") == 1)).alias("nunp_uni1"),
        n(~c("paired") & (c("n") > 1)).alias("nunp_uni2"),
    )


def alignment_rate(m: Row) -> float:
    """Percentage of aligned mates."""
    every = m.nunpaired + 2 * m.npaired
    aligned = 2 * (m.nconcord_uni + m.ndiscord) + m.nunp_0_uni1 + m.nunp_0_uni2 + m.nunp_uni1 + m.nunp_uni2
    return 100.0 * aligned / every if every else 0.0


def summary_text(m: Row, new: bool = False) -> str:
    """The nested summary; new: the tabbed form."""
    pct = lambda a, b: f"{100.0 * a / b if b else 0.0:.2f}%"
    lines: list[tuple[int, str]] = []
    rest = m.nconcord_0 - m.ndiscord
    if new:
        if m.npaired:
            lines += [(1, f"Total pairs: {m.npaired}")]
            lines += [(2, f"{name}: {x} ({pct(x, m.npaired)})") for name, x in (("Aligned concordantly or discordantly 0 time", rest), ("Aligned concordantly 1 time", m.nconcord_uni1), ("Aligned concordantly >1 times", m.nconcord_uni2), ("Aligned discordantly 1 time", m.ndiscord))]
            lines += [(1, f"Total unpaired reads: {2 * rest}")]
            lines += [(2, f"{name}: {x} ({pct(x, 2 * rest)})") for name, x in (("Aligned 0 time", m.nunp_0_0), ("Aligned 1 time", m.nunp_0_uni1), ("Aligned >1 times", m.nunp_0_uni2))]
        else:
            lines += [(1, f"Total reads: {m.nread}")]
            lines += [(2, f"{name}: {x} ({pct(x, m.nunpaired)})") for name, x in (("Aligned 0 time", m.nunp_0), ("Aligned 1 time", m.nunp_uni1), ("Aligned >1 times", m.nunp_uni2))]
        lines += [(1, f"Overall alignment rate: {alignment_rate(m):.2f}%")]
        return "Summary stats:\n" + "".join("\t" * k + x + "\n" for k, x in lines)
    lines += [(0, f"{m.nread} reads" + ("; of these:" if m.nread else ""))]
    if m.npaired:
        lines += [(1, f"{m.npaired} ({pct(m.npaired, m.nread)}) were paired; of these:")]
        lines += [(2, f"{x} ({pct(x, m.npaired)}) aligned concordantly {name}") for name, x in (("0 times", m.nconcord_0), ("exactly 1 time", m.nconcord_uni1), (">1 times", m.nconcord_uni2))]
        lines += [(2, "----"), (2, f"{m.nconcord_0} pairs aligned concordantly 0 times; of these:"), (3, f"{m.ndiscord} ({pct(m.ndiscord, m.nconcord_0)}) aligned discordantly 1 time"), (2, "----")]
        lines += [(2, f"{rest} pairs aligned 0 times concordantly or discordantly; of these:"), (3, f"{2 * rest} mates make up the pairs; of these:")]
        lines += [(4, f"{x} ({pct(x, 2 * rest)}) aligned {name}") for name, x in (("0 times", m.nunp_0_0), ("exactly 1 time", m.nunp_0_uni1), (">1 times", m.nunp_0_uni2))]
    if m.nunpaired:
        lines += [(1, f"{m.nunpaired} ({pct(m.nunpaired, m.nread)}) were unpaired; of these:")]
        lines += [(2, f"{x} ({pct(x, m.nunpaired)}) aligned {name}") for name, x in (("0 times", m.nunp_0), ("exactly 1 time", m.nunp_uni1), (">1 times", m.nunp_uni2))]
    lines += [(0, f"{alignment_rate(m):.2f}% overall alignment rate")]
    return "".join("  " * k + x + "\n" for k, x in lines)


def running(df: DataFrame, column: str) -> DataFrame:
    """Mean and variance of a counter."""
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.var_samp(column).alias("variance"))


def read_lengths(reads: DataFrame) -> DataFrame:
    """(cnt, min, max, avg, lengths) in one row: avg cut to a whole number, lengths by how often they occur, then by length, largest first."""
    per = reads.where("seq is not null").groupBy(F.length("seq").cast("long").alias("len")).agg(F.count("*").alias("n"))
    stats = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cnt"), F.coalesce(F.min("len"), F.lit(0)).alias("min"), F.coalesce(F.max("len"), F.lit(0)).alias("max"), F.sum(F.col("len") * F.col("n")).alias("_s"), F.collect_list(F.struct("n", "len")).alias("_l"))
    return stats.select("cnt", "min", "max", F.when(F.col("cnt") > 0, F.floor(F.col("_s") / F.col("cnt"))).otherwise(0).cast("long").alias("avg"), F.transform(F.sort_array("_l", asc=False), lambda x: x["len"]).alias("lengths"))


def transcripts(exons: DataFrame) -> DataFrame:
    """(transcript_id, gene_id, chrom, strand, exons) with exons in order; the gene, chromosome and strand of the first exon."""
    first = F.min(F.struct("left", "right", "gene_id", "chrom", "strand"))
    return exons.groupBy("transcript_id").agg(first.alias("f"), F.sort_array(F.collect_list(F.struct("left", "right"))).alias("exons")).select("transcript_id", "f.gene_id", "f.chrom", "f.strand", "exons")


def annotation_stats(exons: DataFrame) -> DataFrame:
    """One row: genes, genes_multi (with several transcripts), transcripts, transcript_avg, exons, exon_avg, introns, intron_avg, exons_per_transcript; averages cut. exons are merged ones (transcript_id, gene_id, left, right)."""
    w = Window.partitionBy("transcript_id").orderBy("left", "right")
    rows = exons.withColumn("len", F.col("right") - F.col("left") + 1).withColumn("intron", F.col("left") - F.lag("right").over(w))
    per = rows.groupBy("transcript_id").agg(F.min("gene_id").alias("gene_id"), F.sum("len").alias("len"), F.count("*").alias("n"), F.sum("intron").alias("introns"), F.count("intron").alias("n_introns"))
    genes = per.groupBy("gene_id").agg(F.count("*").alias("t"), F.sum("len").alias("len"), F.sum("n").alias("n"), F.sum("introns").alias("introns"), F.sum("n_introns").alias("n_introns"))
    cut = lambda a, b: F.floor(F.sum(a) / F.nullif(F.sum(b), F.lit(0))).cast("long")
    return genes.agg(
        F.count("*").alias("genes"),
        F.count_if(F.col("t") > 1).alias("genes_multi"),
        F.sum("t").alias("transcripts"),
        cut("len", "t").alias("transcript_avg"),
        F.sum("n").alias("exons"),
        cut("len", "n").alias("exon_avg"),
        F.sum("n_introns").alias("introns"),
        cut("introns", "n_introns").alias("intron_avg"),
        cut("n", "t").alias("exons_per_transcript"),
    )


def site_support(junctions: DataFrame) -> DataFrame:
    """(chrom_id, left, right, fw, left_ext, right_ext, edit_dist, num_reads, first_rdid) of junction uses (rdid, chrom_id, left, right, fw, left_anchor, right_anchor, mismatches, canonical) whose anchors are long enough: 15 bases, 2 more for each mismatch, 6 more if not canonical."""
    need = F.lit(15) + F.col("mismatches") * 2 + F.when(F.col("canonical"), 0).otherwise(6)
    good = junctions.where((F.col("left_anchor") >= need) & (F.col("right_anchor") >= need))
    return good.groupBy("chrom_id", "left", "right", "fw").agg(F.max("left_anchor").alias("left_ext"), F.max("right_anchor").alias("right_ext"), F.min("mismatches").alias("edit_dist"), F.count("*").alias("num_reads"), F.min("rdid").alias("first_rdid"))


def support_cutoff(sites: DataFrame) -> DataFrame:
    """One row (cutoff): the least read count at which over 0.7 of the sites with fewer than 100 reads are reached; 0 without sites."""
    counts = sites.groupBy(F.least(F.col("num_reads"), F.lit(SUPPORT_CAP - 1)).alias("num_reads")).agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.orderBy("num_reads").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", share).where(F.col("share") > SUPPORT_SHARE).agg(F.coalesce(F.min("num_reads"), F.lit(0)).alias("cutoff"))


def novel_sites(sites: DataFrame, near: int = 10) -> DataFrame:
    """Sites to report: known ones aside, those with enough reads, or without edits and at least a hundred-thousandth of the number of sites; of sites within near bases the one with most reads."""
    cutoff = support_cutoff(sites)
    total = sites.agg((F.count("*") / 100000).cast("long").alias("floor"))
    good = sites.crossJoin(F.broadcast(cutoff)).crossJoin(F.broadcast(total)).where((F.col("num_reads") >= F.col("cutoff")) | ((F.col("edit_dist") == 0) & (F.col("num_reads") >= F.col("floor"))))
    keys, order = ["chrom_id", "fw"], ["left", "right"]
    marked = swept(bucketed(good.withColumn("_here", F.struct("left", "right")), "left"), keys, order, "_here", "_last", "last", inclusive=False)
    new = F.coalesce((F.col("left") - F.col("_last.left") > near) | (F.abs(F.col("right") - F.col("_last.right")) > near), F.lit(True)).cast("long")
    groups = swept(marked.withColumn("_new", new), keys, order, "_new", "_g", "sum")
    best = Window.partitionBy("chrom_id", "fw", "_g").orderBy(F.desc("num_reads"), "edit_dist", "left", "right")
    return groups.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("chrom_id", "left", "right", "fw", "num_reads", "edit_dist")


#: Alleles of which all pairs are looked at; of more, those that the mixture weighs most. Rounds of the mixture, and how little of the largest weight an allele may have to stay.
MAX_ALLELES, MIXTURE_ROUNDS, LEAST_WEIGHT = 256, 15, 1e-6


def _shown_kinds(variants: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alignments folded by the known variants they show, and as many others: (kind, n, weight); and how many of them an allele has: (kind, allele, k)."""
    named = variants.join(known.select("variant", F.lit(True).alias("_known")).distinct(), "variant", "left")
    shows = named.groupBy("aln_id").agg(F.array_sort(F.collect_list(F.when(F.col("_known"), F.col("variant")))).alias("shown"), F.count("variant").alias("n"))
    kinds = shows.groupBy("shown", "n").agg(F.count("*").alias("weight")).withColumn("kind", F.xxhash64("shown", "n"))
    hits = kinds.select("kind", F.explode("shown").alias("variant")).join(known, "variant").groupBy("kind", "allele").agg(F.count("*").alias("k"))
    return kinds.select("kind", "n", "weight"), hits


def allele_weights(variants: DataFrame, alleles: DataFrame, error: float = 0.001, rounds: int = MIXTURE_ROUNDS) -> DataFrame:
    """(allele, share): the share of alignments that each allele explains in a mixture of all alleles, by expectation and maximisation; alleles below LEAST_WEIGHT of the largest are dropped on the way.

    Only pairs of a kind of alignment and an allele that has some of its variants are kept, so tables grow
    with those and not with alignments times alleles. Each round is two sums; it is written, so lineage stays short.
    """
    from ..sources.scratch import written

    known = alleles.select("allele", "variant").distinct()
    kinds, hits = _shown_kinds(variants, known)
    kinds = written(kinds, "kinds")
    all_weight = kinds.agg(F.sum("weight")).first()[0] or 1
    fits = hits.join(kinds, "kind").select("kind", "allele", "weight", (F.exp(-2.0 * (F.col("n") - F.col("k"))) + error).alias("fit"), (F.exp(-2.0 * F.col("n")) + error).alias("rest"))
    fits = written(fits, "fits")
    share = fits.groupBy("allele").agg(F.lit(1.0).alias("share"))
    count = share.count()
    share = share.withColumn("share", F.lit(1.0 / max(1, count)))
    for _ in range(rounds):
        weighed = fits.join(share, "allele").withColumn("part", F.col("share") * F.col("fit"))
        # alleles without any of the variants explain a kind no better than the error does
        total = weighed.groupBy("kind").agg((F.sum("part") + (F.lit(1.0) - F.sum("share")) * F.max("rest")).alias("total"))
        new = weighed.join(total, "kind").groupBy("allele").agg((F.sum(F.col("weight") * F.col("part") / F.col("total")) / all_weight).alias("share"))
        new = written(new, "shares")
        least = (new.agg(F.max("share")).first()[0] or 0.0) * LEAST_WEIGHT
        share = new.where(F.col("share") >= least)
    return share


def allele_likelihood(variants: DataFrame, alleles: DataFrame, error: float = 0.001) -> DataFrame:
    """(allele_a, allele_b, log_likelihood) of pairs of alleles.

    variants: (aln_id, variant), what each alignment shows; alleles: (allele, variant). An allele's score
    for an alignment is -2 for each shown variant that it lacks; a pair's likelihood is the sum over
    alignments of the logarithm of the mean of both. Of more than MAX_ALLELES alleles, the pairs of those
    that the mixture (allele_weights) weighs most are looked at. Alignments are folded first, so the cost
    goes by the different sets of variants that they show.
    """
    known = alleles.select("allele", "variant").distinct()
    if known.select("allele").distinct().count() > MAX_ALLELES:
        best = allele_weights(variants, known, error).orderBy(F.desc("share"), "allele").limit(MAX_ALLELES)
        named = best.select("allele")
    else:
        named = known.select("allele").distinct()
    names = [r["allele"] for r in named.collect()]  # at most MAX_ALLELES
    kinds, hits = _shown_kinds(variants, known.where(F.col("allele").isin(names)).unionByName(known.withColumn("allele", F.lit(None).cast(known.schema["allele"].dataType))))
    hits = hits.where("allele is not null")
    # of each kind the scores of the alleles that hold some of it; all others lack everything
    told = kinds.join(hits.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("allele", "k"))).alias("held")), "kind", "left")
    score = -2.0 * (F.col("n") - F.coalesce(F.try_element_at("held", F.col("allele")), F.lit(0)))
    scored = told.select("kind", "weight", "n", "held", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<bigint>")).alias("allele")).select("kind", "weight", "allele", score.alias("s"))
    a, b = scored.select("kind", "weight", F.col("allele").alias("allele_a"), F.col("s").alias("sa")), scored.select("kind", F.col("allele").alias("allele_b"), F.col("s").alias("sb"))
    both = a.join(b, "kind").where("allele_a <= allele_b")
    return both.groupBy("allele_a", "allele_b").agg(F.sum(F.col("weight") * F.ln((F.exp("sa") + F.exp("sb")) / 2 + error)).alias("log_likelihood"))


def typed_pair(variants: DataFrame, alleles: DataFrame, error: float = 0.001) -> DataFrame:
    """The pair of alleles of the highest likelihood (the smallest names among equal ones, to four digits), one row."""
    pairs = allele_likelihood(variants, alleles, error).withColumn("log_likelihood", F.round("log_likelihood", 4))
    return pairs.orderBy(F.desc("log_likelihood"), "allele_a", "allele_b").limit(1)


def is_concordant(chrom1: Column, fw1: Column, start1: Column, chrom2: Column, fw2: Column, end2: Column, clip2: Column, most: int = 1000) -> Column:
    """Same chromosome, first mate forward and second reverse, and a reference span, less the right soft clip, of at most most bases."""
    return (chrom1 == chrom2) & fw1 & ~fw2 & (end2 - clip2 - start1 + 1 <= most)
