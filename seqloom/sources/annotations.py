"""Scans of references, variants, haplotypes, splice sites, exons, GTF, VCF, dbSNP dumps, repeats and SAM. Places count from 0 unless noted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cigar import cigar_end
from ..functions.seq import reverse_complement
from .reads import fasta_records


def reference(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, chrom_id, len, seq); letters other than A, C, G, T become N."""
    df = fasta_records(spark, path)
    seq = F.regexp_replace(F.upper("seq"), "[^ACGT]", "N")
    return df.select(F.regexp_extract("name", r"^(\S*)", 1).alias("chrom"), F.col("ordinal").alias("chrom_id"), F.length("seq").cast("long").alias("len"), seq.alias("seq"))


def stretches(ref: DataFrame) -> DataFrame:
    """(chrom_id, tstart, joined_start, len) of the runs of A, C, G, T, and where they lie in the joined text."""
    runs = F.regexp_extract_all("seq", F.lit("([ACGT]+|[^ACGT]+)"), F.lit(1))
    laid = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<tstart:long,len:long>>").alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r)).cast("long").alias("at"),
            F.when(r.rlike("^[ACGT]"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("tstart"), F.length(r).cast("long").alias("len"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    rows = ref.select("chrom_id", F.explode(laid).alias("s")).select("chrom_id", "s.tstart", "s.len")
    per = rows.groupBy("chrom_id").agg(F.sum("len").alias("total"))
    shifts = per.select("chrom_id", F.coalesce(F.sum("total").over(Window.orderBy("chrom_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("chrom_id").orderBy("tstart").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(shifts, "chrom_id").select("chrom_id", "tstart", (F.col("shift") + F.coalesce(F.sum("len").over(inside), F.lit(0))).alias("joined_start"), "len")


def reference_windows(places: DataFrame, ref: DataFrame) -> DataFrame:
    """Adds bases: the len reference bases from pos on, for places (chrom, pos, len)."""
    return places.join(ref.select("chrom", F.col("seq").alias("_seq")), "chrom").withColumn("bases", F.substring("_seq", F.col("pos").cast("int") + 1, F.col("len").cast("int"))).drop("_seq")


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, comment="#", quote="")


def variants(spark: SparkSession, path: str, ref: DataFrame) -> DataFrame:
    """(id, type, chrom, pos, data) that fit the reference: no unknown chrom, nothing in or next to N, no variant equal to the reference, insertions of up to 32 known bases."""
    rows = _tsv(spark, path, "id string, type string, chrom string, pos long, data string")
    at = rows.join(ref.select("chrom", F.col("seq").alias("_s"), F.col("len").alias("_len")), "chrom")
    pos = F.col("pos").cast("int")
    width = F.when(F.col("type") == "deletion", F.col("data").try_cast("int")).otherwise(F.lit(1))
    around = F.substring("_s", F.greatest(pos, F.lit(1)), width + F.when(pos > 0, 2).otherwise(1))
    fits = (
        ((F.col("type") == "single") & F.col("data").rlike("^[ACGT]$") & (F.substring("_s", pos + 1, F.lit(1)) != F.col("data")))
        | ((F.col("type") == "deletion") & (F.col("data").try_cast("int") > 0))
        | ((F.col("type") == "insertion") & F.col("data").rlike("^[ACGT]{1,32}$"))
    )
    inside = (F.col("pos") >= 0) & (F.col("pos") + width <= F.col("_len")) & ~F.contains(around, F.lit("N"))
    return at.where(fits & inside).select("id", "type", "chrom", "pos", "data")


def haplotypes(spark: SparkSession, path: str | None, snps: DataFrame) -> DataFrame:
    """(hid, chrom, left, right, alts), alts the ids that are known; without a file, one haplotype for each variant."""
    if path is None:
        right = F.when(F.col("type") == "deletion", F.col("pos") + F.col("data").try_cast("long") - 1).otherwise(F.col("pos"))
        return snps.select(F.concat(F.lit("ht_"), "id").alias("hid"), "chrom", F.col("pos").alias("left"), right.alias("right"), F.array("id").alias("alts"))
    rows = _tsv(spark, path, "hid string, chrom string, left long, right long, ids string")
    ids = rows.select("hid", "chrom", "left", "right", F.posexplode(F.split("ids", ",")).alias("k", "id"))
    known = ids.join(snps.select("id").distinct(), "id", "left_semi")
    kept = known.groupBy("hid", "chrom", "left", "right").agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias("a"))
    return kept.select("hid", "chrom", "left", "right", F.transform("a", lambda x: x["id"]).alias("alts"))


def splice_sites(spark: SparkSession, path: str, ref: DataFrame | None = None) -> DataFrame:
    """(chrom, left, right, fw): left < right, on known chromosomes and inside them, outside of N; any strand but + is reverse; no duplicates."""
    rows = _tsv(spark, path, "chrom string, left long, right long, strand string").where("left < right")
    rows = rows.select("chrom", "left", "right", F.coalesce(F.col("strand") == "+", F.lit(False)).alias("fw"))
    if ref is not None:
        at = rows.join(ref.select("chrom", F.col("seq").alias("_s"), F.col("len").alias("_len")), "chrom").where("left >= 0 and right < _len")
        base = lambda c: F.substring("_s", F.col(c).cast("int") + 1, F.lit(1)) != "N"
        rows = at.where(base("left") & base("right")).drop("_s", "_len")
    return rows.dropDuplicates(["chrom", "left", "right"])


def exons(spark: SparkSession, path: str, ref: DataFrame | None = None) -> DataFrame:
    """(chrom, left, right, fw), with the rules of splice sites."""
    return splice_sites(spark, path, ref)


def gtf_exons(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, left, right, strand, gene_id, transcript_id) of exon lines with left < right and both ids; places count from 1, both ends included."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("l")).where("l <> ''")
    f = lines.select(F.split("l", "\t", -1).alias("f")).where("size(f) = 9")
    value = lambda name: F.nullif(F.regexp_extract(F.col("f")[8], rf'(?:^|;)\s*{name} "?([^";]*)"?', 1), F.lit(""))
    rows = f.select(F.col("f")[0].alias("chrom"), F.col("f")[2].alias("feature"), F.col("f")[3].try_cast("long").alias("left"), F.col("f")[4].try_cast("long").alias("right"), F.col("f")[6].alias("strand"), value("gene_id").alias("gene_id"), value("transcript_id").alias("transcript_id"))
    return rows.where("feature = 'exon' and left < right and gene_id is not null and transcript_id is not null").drop("feature")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alts, info, genotypes): pos from 0, alts and genotypes arrays."""
    f = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t", -1).alias("f")).where("size(f) >= 8")
    return f.select(
        F.col("f")[0].alias("chrom"),
        (F.col("f")[1].cast("long") - 1).alias("pos"),
        F.col("f")[2].alias("id"),
        F.col("f")[3].alias("ref"),
        F.split(F.col("f")[4], ",").alias("alts"),
        F.col("f")[7].alias("info"),
        F.when(F.size("f") > 9, F.transform(F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))), lambda g: F.regexp_extract(g, "^([^:]*)", 1))).alias("genotypes"),
    )


def clinical(rows: DataFrame) -> DataFrame:
    """VCF rows whose clinical significance is 4 or 5 (likely pathogenic, pathogenic)."""
    return rows.where(F.regexp_extract("info", r"(?:^|;)CLNSIG=([^;]*)", 1).rlike(r"(^|[^0-9])[45]([^0-9]|$)"))


def dbsnp(spark: SparkSession, path: str) -> DataFrame:
    """(id, chrom, pos, end, type, alleles, frequencies) of genomic single bases, deletions and insertions; the first row of each id; alleles on the forward strand."""
    from .reads import lines_of, with_ordinal

    f = with_ordinal(lines_of(spark, path).withColumn("f", F.split("value", "\t", -1)).where("size(f) = 26"), "n", files=True)
    x = lambda k: F.col("f")[k]
    alleles = F.split(x(9), "/")
    rows = f.where((x(10) == "genomic") & x(11).isin("single", "deletion", "insertion")).select(
        "n", x(4).alias("id"), x(1).alias("chrom"), x(2).cast("long").alias("pos"), x(3).cast("long").alias("end"), x(7).alias("ref"), x(11).alias("type"),
        F.when(x(6) == "-", F.transform(alleles, reverse_complement)).otherwise(alleles).alias("alleles"),
        F.transform(F.filter(F.split(x(24), ","), lambda v: v != ""), lambda v: v.cast("double")).alias("frequencies"),
    )
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("n"))).where("k = 1")
    width = F.col("end") - F.col("pos")
    fits = ((F.col("type") == "single") & (width == 1)) | ((F.col("type") == "deletion") & (width > 0)) | ((F.col("type") == "insertion") & (width == 0))
    named = F.array_contains("alleles", F.col("ref")) | ((F.col("type") == "insertion") & F.array_contains("alleles", F.lit("-")))
    return first.where(fits & named).drop("k", "n")


def repeat_info(spark: SparkSession, path: str) -> DataFrame:
    """(name, rep, pos, len, snps, positions): header lines ``>name rep pos len n n_snps snps`` followed by ``chrom:pos:strand`` places."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    lines = raw.select(F.split("value", r"\n").alias("l"))
    head, rest = F.split(F.col("l")[0], r"\s+"), F.array_join(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))), " ")
    places = F.transform(F.regexp_extract_all(rest, F.lit(r"(\S+:\d+:[+-])"), F.lit(1)), lambda p: F.struct(F.regexp_extract(p, r"^(.*):\d+:[+-]$", 1).alias("chrom"), F.regexp_extract(p, r":(\d+):[+-]$", 1).cast("long").alias("pos"), F.substring(p, -1, 1).alias("strand")))
    snps = F.filter(F.split(F.coalesce(F.try_element_at(head, F.lit(7)), F.lit("")), ","), lambda x: x != "")
    return lines.select(head[0].alias("name"), head[1].alias("rep"), head[2].cast("long").alias("pos"), head[3].cast("long").alias("len"), snps.alias("snps"), places.alias("positions"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines: the eleven fields (pos from 0, null if unmapped), end, and tags as a map of name to value."""
    f = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t", -1).alias("f")).where("size(f) >= 11")
    x = lambda k: F.col("f")[k]
    pos = F.when(x(3).cast("long") > 0, x(3).cast("long") - 1)
    tags = F.map_from_entries(F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.regexp_replace(t, r"^..:.:", "").alias("value"))))
    return f.select(
        x(0).alias("qname"), x(1).cast("int").alias("flag"), x(2).alias("chrom"), pos.alias("pos"), x(4).cast("int").alias("mapq"), x(5).alias("cigar"),
        x(6).alias("rnext"), (x(7).cast("long") - 1).alias("pnext"), x(8).cast("long").alias("tlen"), x(9).alias("seq"), x(10).alias("qual"), cigar_end(pos, x(5)).alias("end"), tags.alias("tags"),
    )
