"""Read and sequence scans. Every scan gives (rdid, mate, name, seq, qual, filter); rdid counts the records of the input from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import decode_quality, integer_quality, quality_string
from .scratch import written

COLUMNS = ("rdid", "mate", "name", "seq", "qual", "filter")


def with_ordinal(df: DataFrame, name: str, files: bool = False) -> DataFrame:
    """Numbers the rows in the order of the scan, without gaps: by partition, or with files (columns _file and _at, as lines_of() gives them) by file name and block. Blocks are numbered one by one and shifted by the counts of those before them (one row each).

    Partitions are not the same ones in two reads of a shuffle (AQE merges them by size, which differs with the columns read), so rows are written with theirs once.
    """
    block = ["_file", "_at"] if files else ["_part"]
    marked = (df if files else df.withColumn("_part", F.spark_partition_id())).withColumn("_row", F.monotonically_increasing_id())
    if not files:
        marked = written(marked, "ordinal")
    # within a block the ids follow each other, so a row's place is its id less the block's first
    counts = marked.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = counts.select(*block, "_first", F.coalesce(F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return marked.join(F.broadcast(before), block).withColumn(name, F.col("_before") + F.col("_row") - F.col("_first")).drop(*block, "_row", "_before", "_first")


def lines_of(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of a file, or of the files of a folder in the order of their names: value, with _file and _at for with_ordinal()."""
    rows = spark.read.options(**options).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))


def _reads(df: DataFrame, **columns: Column) -> DataFrame:
    nothing = F.lit(None).cast("string")
    found = {"mate": F.lit(0), "name": nothing, "qual": nothing, "filter": nothing} | columns
    return df.select(*(found[c].cast({"rdid": "long", "mate": "int"}.get(c, "string")).alias(c) for c in COLUMNS))


def constant_quality(seq: Column) -> Column:
    return F.repeat(F.lit("I"), F.length(seq))


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, seq): comment lines start with # or ;, records may be empty."""
    raw = lines_of(spark, path, lineSep=">").where(F.length(F.trim("value")) > 0)
    lines = F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x))  # a second argument would be the place
    parts = with_ordinal(raw.select(lines.alias("l"), "_file", "_at"), "ordinal", files=True)
    body = F.filter(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))), lambda x: ~x.rlike("^[#;]"))
    return parts.select("ordinal", F.col("l")[0].alias("name"), F.array_join(body, "").alias("seq"))


def fasta(spark: SparkSession, path: str, mate: int = 0) -> DataFrame:
    """Records without bases are skipped but keep their number."""
    df = fasta_records(spark, path).where("seq <> ''")
    return _reads(df, rdid=F.col("ordinal"), mate=F.lit(mate), name=F.col("name"), seq=F.upper("seq"), qual=constant_quality(F.col("seq")))


def sampled_windows(records: DataFrame, length: int, every: int) -> DataFrame:
    """Reads of length bases, one every so many bases of the records (ordinal, name, seq), in the order of the records."""
    starts = F.when(F.length("seq") >= length, F.sequence(F.lit(0), F.length("seq") - length, F.lit(every)))
    windows = records.select("ordinal", "name", "seq", F.explode(starts).alias("at"))
    rows = windows.select("ordinal", "at", F.concat_ws("_", "name", F.col("at") + 1).alias("name"), F.substring("seq", F.col("at") + 1, F.lit(length)).alias("seq"))
    df = with_ordinal(rows.repartitionByRange("ordinal", "at").sortWithinPartitions("ordinal", "at"), "number")
    return _reads(df, rdid=F.col("number"), name=F.col("name"), seq=F.col("seq"), qual=F.lit("I" * length))


def decoded(qual: Column, scale: str) -> Column:
    """Quality string in phred33; scale integers: numbers with blanks between."""
    if scale == "phred33":
        return qual
    if scale == "integers":
        return quality_string(F.transform(F.split(F.trim(qual), r"\s+"), lambda x: integer_quality(x.cast("int"), capped=False)))
    letters = F.filter(F.split(qual, ""), lambda c: c != "")
    return quality_string(F.transform(letters, lambda c: decode_quality(c, scale)))


def fastq(spark: SparkSession, path: str, mate: int = 0, scale: str = "phred33") -> DataFrame:
    """Four-line records."""
    lines = with_ordinal(lines_of(spark, path), "n", files=True)
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.regexp_replace("value", r"\r$", "")))
    df = lines.groupBy(F.floor(F.col("n") / 4).alias("ordinal")).agg(line(0).alias("name"), line(1).alias("seq"), line(3).alias("qual")).where("seq is not null")
    return _reads(df, rdid=F.col("ordinal"), mate=F.lit(mate), name=F.regexp_replace("name", "^@", ""), seq=F.upper("seq"), qual=decoded(F.col("qual"), scale))


def tabbed(spark: SparkSession, path: str, scale: str = "phred33") -> DataFrame:
    """Lines of 3 fields (name, seq, qual), 5 (name, two mates) or 6 (a name for each mate)."""
    df = with_ordinal(lines_of(spark, path), "ordinal", files=True).withColumn("f", F.split("value", "\t", -1))
    n = F.size("f")
    mate = lambda m, a, b, c: F.struct(F.lit(m).alias("mate"), F.col("f")[a].alias("name"), F.col("f")[b].alias("seq"), F.col("f")[c].alias("qual"))
    mates = F.when(n == 3, F.array(mate(0, 0, 1, 2))).when(n == 5, F.array(mate(1, 0, 1, 2), mate(2, 0, 3, 4))).when(n == 6, F.array(mate(1, 0, 1, 2), mate(2, 3, 4, 5)))
    df = df.select("ordinal", F.explode(mates).alias("m")).select("ordinal", "m.*")
    return _reads(df, rdid=F.col("ordinal"), mate=F.col("mate"), name=F.col("name"), seq=F.upper("seq"), qual=decoded(F.col("qual"), scale))


def qseq(spark: SparkSession, path: str, scale: str = "phred33") -> DataFrame:
    """Eleven tab fields: machine, run, lane, tile, x, y, index, mate, seq, qual, filter."""
    df = with_ordinal(lines_of(spark, path), "ordinal", files=True).withColumn("f", F.split("value", "\t", -1)).where("size(f) = 11")
    name = F.concat(F.array_join(F.slice("f", 1, 7), "_"), F.lit("/"), F.col("f")[7])
    return _reads(df, rdid=F.col("ordinal"), name=name, seq=F.upper(F.translate(F.col("f")[8], ".", "N")), qual=decoded(F.col("f")[9], scale), filter=F.col("f")[10])


def raw(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a line; the name is the number."""
    df = with_ordinal(lines_of(spark, path), "ordinal", files=True).where("trim(value) <> ''")
    return _reads(df, rdid=F.col("ordinal"), name=F.col("ordinal"), seq=F.upper(F.trim("value")), qual=constant_quality(F.trim("value")))


def literal(spark: SparkSession, sequences: list[str]) -> DataFrame:
    """Sequences given on the spot."""
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sequences)], "ordinal long, seq string")
    return _reads(df, rdid=F.col("ordinal"), name=F.col("ordinal"), seq=F.upper("seq"), qual=constant_quality(F.col("seq")))


def accession(spark: SparkSession, name: str) -> DataFrame:
    """Archive accessions need a network client that is not part of this library."""
    raise NotImplementedError(f"no archive client for {name!r}; download the reads and scan the file")


def with_quality_file(reads: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Replaces the qualities by those of a parallel file of records of numbers, by record number."""
    numbers = fasta_records(spark, path).select(F.col("ordinal").alias("rdid"), F.trim("seq").alias("_numbers"))
    raw_numbers = lines_of(spark, path, lineSep=">").where(F.length(F.trim("value")) > 0)
    told = with_ordinal(raw_numbers.select(F.trim(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s+", " ")).alias("q"), "_file", "_at"), "rdid", files=True)
    return reads.drop("qual").join(numbers.select("rdid").join(told, "rdid"), "rdid", "left").withColumn("qual", decoded(F.col("q"), "integers")).select(*COLUMNS)


def interleaved(reads: DataFrame) -> DataFrame:
    """Every two records are the mates of a pair."""
    return reads.withColumn("mate", (F.col("rdid") % 2 + 1).cast("int")).withColumn("rdid", F.floor(F.col("rdid") / 2)).select(*COLUMNS)


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two scans, record for record; a record that has no counterpart is an error."""
    a, b = first.withColumn("mate", F.lit(1)), second.withColumn("mate", F.lit(2))
    both = a.unionByName(b).withColumn("_n", F.count("*").over(Window.partitionBy("rdid")))
    checked = F.when(F.col("_n") == 2, F.col("rdid")).otherwise(F.raise_error(F.lit("the two files do not hold the same records")).cast("long"))
    return both.withColumn("rdid", checked).select(*COLUMNS)


def scan(spark: SparkSession, path: str, form: str = "fastq", **options) -> DataFrame:
    """By format name; .gz and .bz2 files are read through Spark's codecs."""
    scans = {"fasta": fasta, "fastq": fastq, "tab5": tabbed, "tab6": tabbed, "qseq": qseq, "raw": raw}
    if form not in scans:
        raise ValueError(f"no read format {form!r}")
    return scans[form](spark, path, **options)
