"""SAM text, read routing, annotation tables, inspection of an index, results tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.config import Options
from ..functions.seq import reverse_complement


def sam_header(ref: DataFrame, o: Options = Options(), program: str = "seqloom", version: str = "0.1") -> DataFrame:
    """Header lines (n, value); one for each reference sequence."""
    spark = ref.sparkSession
    parts = []
    if not o.no_hd:
        parts.append(spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit("@HD\tVN:1.0\tSO:unsorted").alias("value")))
        if not o.no_sq:
            parts.append(ref.select((F.col("chrom_id") + 1).alias("n"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "chrom"), F.concat(F.lit("LN:"), F.length("seq"))).alias("value")))
        if o.rg_id:
            parts.append(spark.range(1).select(F.lit(1 << 61), F.lit("\t".join(["@RG", f"ID:{o.rg_id}", *o.rg]))))
        parts.append(spark.range(1).select(F.lit(1 << 62), F.lit(f"@PG\tID:{program}\tPN:{program}\tVN:{version}")))
    out = parts[0] if parts else spark.range(0).select(F.col("id").alias("n"), F.lit("").alias("value"))
    for p in parts[1:]:
        out = out.union(p)
    return out


def sam_line(r: dict[str, Column]) -> Column:
    """One line: the eleven fields; an unmapped mate stands at its mate's place."""
    star = lambda c: F.coalesce(c, F.lit("*"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.concat_ws(
        "\t", r["qname"], r["flag"], star(r["chrom"]), zero(r["pos"] + 1), zero(r["mapq"]), star(r["cigar"]),
        F.when(r["mate_chrom"].isNull(), "*").when(r["mate_chrom"] == r["chrom"], "=").otherwise(r["mate_chrom"]),
        zero(r["mate_pos"] + 1), zero(r["tlen"]), star(r["seq"]), star(r["qual"]), r["tags"],
    )


def tags(**values: Column) -> Column:
    """Tags by name (AS=..., XS_A=...) in the order given; nulls are left out."""
    kinds = {"AS": "i", "ZS": "i", "XN": "i", "XM": "i", "XO": "i", "XG": "i", "NM": "i", "YS": "i", "NH": "i", "MD": "Z", "YF": "Z", "YT": "Z", "Zs": "Z", "XS": "A", "YM": "i", "YP": "i"}
    return F.concat_ws("\t", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}:{kinds[k]}:"), v.cast("string"))) for k, v in values.items()))


def sam_records(alns: DataFrame, o: Options = Options()) -> DataFrame:
    """(rdid, mate, rank, value) lines of alignments (see plans.align.report); unmapped reads have a null chrom."""
    rows = alns.where(F.col("chrom").isNotNull()) if o.no_unal else alns
    return rows.select("rdid", "mate", "rank", sam_line({c: F.col(c) for c in ("qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "qual", "tags")}).alias("value"))


def ordered(records: DataFrame) -> DataFrame:
    """Lines in the order of the input."""
    return records.orderBy("rdid", "mate", "rank")


def write_sam(path: str, header: DataFrame, records: DataFrame) -> None:
    """Header and records as text files in two folders, header and records."""
    header.orderBy("n").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    records.select("value").write.mode("overwrite").text(f"{path}/records")


def routed(reads: DataFrame, alns: DataFrame) -> DataFrame:
    """Reads with kinds, the names of the outputs they go to: un, al (unpaired), un_conc, al_conc, al_conc_disc (pairs); secondary records do not count."""
    first = alns.where(F.col("flag").bitwiseAND(256) == 0)
    per = first.groupBy("rdid").agg(
        F.max(F.col("flag").bitwiseAND(1)).alias("paired"),
        F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("mapped"),
        F.max(F.col("flag").bitwiseAND(2)).alias("proper"),
        F.max(F.when(F.col("yt") == "DP", 1).otherwise(0)).alias("disc"),
    )
    j = reads.join(per, "rdid", "left")
    paired = F.coalesce(F.col("paired") == 1, F.lit(False))
    none = F.coalesce(F.col("mapped"), F.lit(0)) == 0
    proper = F.coalesce(F.col("proper") == 2, F.lit(False))
    when = {"un": ~paired & none, "al": ~paired & ~none, "un_conc": paired & ~proper, "al_conc": paired & proper, "al_conc_disc": paired & (proper | (F.col("disc") == 1))}
    kinds = F.array_compact(F.array(*(F.when(c, kind) for kind, c in when.items())))
    return j.select(*reads.columns, kinds.alias("kinds"))


def route(reads: DataFrame, alns: DataFrame) -> dict[str, DataFrame]:
    """A table for each of the kinds of routed()."""
    found = routed(reads, alns)
    return {kind: found.where(F.array_contains("kinds", kind)).drop("kinds") for kind in ("un", "al", "un_conc", "al_conc", "al_conc_disc")}


def fastq_lines(reads: DataFrame, *keep: str) -> DataFrame:
    """Four-line records as one value each, with the columns keep."""
    return reads.select(*keep, F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=False)


def snp_lines(variants: DataFrame) -> DataFrame:
    """(id, type, chrom, pos, data) with whole type names."""
    kind = F.when(F.col("type").isin("S", "single"), "single").when(F.col("type").isin("D", "deletion"), "deletion").otherwise("insertion")
    return variants.select(F.col("id2").alias("id"), kind.alias("type"), "chrom", "pos", "data")


def haplotype_lines(haplotypes: DataFrame) -> DataFrame:
    return haplotypes.select("hid", "chrom", "left", "right", F.array_join("alts", ",").alias("ids"))


def fasta_text(ref: DataFrame, across: int = 60) -> DataFrame:
    """Records with lines of across letters; unknown letters as N."""
    body = F.regexp_replace(F.regexp_replace("seq", "[^ACGT]", "N"), f"(.{{{across}}})(?=.)", "$1\n")
    return ref.select("chrom_id", F.concat(F.lit(">"), "chrom", F.lit("\n"), body).alias("value"))


def index_names(ref: DataFrame) -> DataFrame:
    return ref.select("chrom_id", "chrom")


def index_splice_sites(alts: DataFrame, every: bool = False) -> DataFrame:
    """(chrom, left, right, strand) of an index's splice sites; every: those that were taken from exons, too."""
    rows = alts.where("type = 'splice'")
    if not every and "excluded" in alts.columns:
        rows = rows.where("not excluded")
    return rows.select("chrom", "left", "right", F.when(F.col("fw"), "+").otherwise("-").alias("strand"))


def index_exons(alts: DataFrame) -> DataFrame:
    return alts.where("type = 'exon'").select("chrom", "left", "right", F.when(F.col("fw"), "+").otherwise("-").alias("strand"))


def index_summary(ref: DataFrame, kmers: DataFrame, alts: DataFrame | None = None) -> DataFrame:
    """One row: sequences, bases, unknown, kmers, distinct_kmers, variants."""
    told = ref.agg(F.count("*").alias("sequences"), F.sum(F.length("seq")).alias("bases"), F.sum(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit("N"), F.lit("")))).alias("unknown"))
    keys = kmers.groupBy("kmer").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kmers"), F.count("*").alias("distinct_kmers"))
    n = alts.agg(F.count("*").alias("variants")) if alts is not None else ref.sparkSession.range(1).select(F.lit(0).cast("long").alias("variants"))
    return told.crossJoin(F.broadcast(keys)).crossJoin(F.broadcast(n))


def repeat_files(repeats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consensus records and info records (a header, then ten places a line) of repeats (rep_id, consensus, positions)."""
    fasta = repeats.select("rep_id", F.concat(F.lit(">rep_"), F.col("rep_id").cast("string"), F.lit("\n"), "consensus").alias("value"))
    places = F.transform("positions", lambda p: F.concat_ws(":", p["chrom_id"].cast("string"), p["pos"].cast("string"), F.when(p["fw"], "+").otherwise("-")))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("positions") - 1) / 10).cast("int")), lambda k: F.array_join(F.slice(places, k * 10 + 1, F.lit(10)), " "))
    head = F.concat_ws("\t", F.concat(F.lit(">rpt_"), F.col("rep_id").cast("string")), F.lit("rep"), F.lit("0"), F.length("consensus").cast("string"), F.size("positions").cast("string"), F.lit("0"))
    return fasta, repeats.select("rep_id", F.concat(head, F.lit("\n"), F.array_join(lines, "\n")).alias("value"))


def results_table(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> DataFrame:
    """Appends rows of a benchmark run to a parquet table and gives the table."""
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def reported_strand(seq: Column, fw: Column) -> Column:
    return F.when(fw, seq).otherwise(reverse_complement(seq))


def metrics_rows(df: DataFrame, by: str, every: int) -> DataFrame:
    """Counters so far after each so many reads: one row for each step."""
    step = F.floor(F.col(by) / every).alias("step")
    per = df.groupBy(step).agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
