"""Queries of readers and writers: driver tables are written in each format and scanned again, and compared with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import Options
from ..functions.seq import text_to_bases
from ..operators import annotation, index, metrics
from ..sources import annotations, reads, sinks
from ..sources.scratch import scratch, text_file, written
from .registry import _DEDUP, _MAP, _VARIANTS, _VORDER, K, READS, REF, longs, query, reads_of, ref_of, t, variants_of

_CONST = "repeat('I', length(seq))"
#: All bases of each document, numbered by doc_id, with qualities that run through a pattern.
_SHORT = f"short AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, doc_id, seq FROM (SELECT doc_id, {_MAP} AS seq FROM documents) WHERE seq <> '')"
_PATTERN = "substring(repeat('{}', length(seq)), 1, length(seq))"


def numbered(df: DataFrame, by: str) -> DataFrame:
    """df with n, its number in the order of by."""
    return reads.with_ordinal(df.repartitionByRange(by).sortWithinPartitions(by), "n")


def short_reads(spark, sf_dir) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select("doc_id", text_to_bases("text").alias("seq")).where("seq <> ''")
    return written(numbered(rows, "doc_id"), "short")


def quality(pattern: str) -> Column:
    return F.expr(f"substring(repeat('{pattern}', length(seq)), 1, length(seq))")


def fastq_file(rows: DataFrame, pattern: str, compression: str = "none") -> str:
    """One line break in each record, so a record is four lines of the file."""
    return text_file(sinks.fastq_lines(rows.select("n", F.concat(F.lit("r"), "doc_id").alias("name"), "seq", quality(pattern).alias("qual")), "n"), "fastq", compression)


def named_ref(spark, sf_dir) -> DataFrame:
    """benchmark as chromosomes b<item_id>; all that is no letter is unknown."""
    masked = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", "N"), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])
    rows = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chrom_id"), F.concat(F.lit("b"), "item_id").alias("chrom"), masked.alias("seq"))
    return rows.withColumn("len", F.length("seq").cast("long"))


_MASKED = "translate(regexp_replace(lower(text), '[^a-z]', 'N', 'g'), 'abcdefghijklmnopqrstuvwxyz', '" + ("ACGT" * 7)[:26] + "')"
_NREF = f"nref AS (SELECT item_id, 'b' || item_id AS chrom, {_MASKED} AS seq FROM benchmark)"


# ---- reads --------------------------------------------------------------------------------------


@query(f"WITH {_SHORT} SELECT n AS rdid, 'b' || doc_id AS name, seq, {_CONST} AS qual FROM short")
def fasta_scan(spark, sf_dir):
    rows = short_reads(spark, sf_dir).select("n", F.concat(F.lit("b"), "doc_id").alias("chrom"), F.col("n").alias("chrom_id"), "seq")
    path = text_file(sinks.fasta_text(rows, 60).withColumnRenamed("chrom_id", "n"), "fasta")
    return reads.scan(spark, path, "fasta").select("rdid", "name", "seq", "qual")


@query(
    f"WITH {_SHORT}, w AS (SELECT n, doc_id, seq, unnest(range(0, length(seq) - 39, 7)) AS s FROM short WHERE length(seq) >= 40) "
    "SELECT row_number() OVER (ORDER BY n, s) - 1 AS rdid, 'b' || doc_id || '_' || (s + 1) AS name, substring(seq, s + 1, 40) AS seq FROM w"
)
def fasta_windows(spark, sf_dir):
    rows = short_reads(spark, sf_dir).select("n", F.concat(F.lit("b"), "doc_id").alias("chrom"), F.col("n").alias("chrom_id"), "seq")
    path = text_file(sinks.fasta_text(rows, 60).withColumnRenamed("chrom_id", "n"), "fasta")
    return reads.sampled_windows(reads.fasta_records(spark, path), 40, 7).select("rdid", "name", "seq")


@query(f"WITH {_SHORT} SELECT n AS rdid, 'r' || doc_id AS name, seq, {_PATTERN.format('I5+!?')} AS qual FROM short")
def fastq_scan(spark, sf_dir):
    return reads.scan(spark, fastq_file(short_reads(spark, sf_dir), "I5+!?"), "fastq").select("rdid", "name", "seq", "qual")


@query(f"WITH {_SHORT} SELECT n AS rdid, 'r' || doc_id AS name, seq, {_PATTERN.format('I5+!?')} AS qual FROM short")
def fastq_gz_scan(spark, sf_dir):
    return reads.scan(spark, fastq_file(short_reads(spark, sf_dir), "I5+!?", "gzip"), "fastq").select("rdid", "name", "seq", "qual")


@query(f"WITH {_SHORT} SELECT n AS rdid, {_PATTERN.format('I5#!')} AS qual FROM short")
def fastq_phred64_scan(spark, sf_dir):
    return reads.scan(spark, fastq_file(short_reads(spark, sf_dir), "hTB@"), "fastq", scale="phred64").select("rdid", "qual")


@query(f"WITH {_SHORT} SELECT n AS rdid, {_PATTERN.format('$+5')} AS qual FROM short")
def fastq_solexa_scan(spark, sf_dir):
    return reads.scan(spark, fastq_file(short_reads(spark, sf_dir), "@JT"), "fastq", scale="solexa").select("rdid", "qual")


@query(f"WITH {_SHORT} SELECT n AS rdid, repeat('I5!~', length(seq)) AS qual FROM short")
def fastq_integers_scan(spark, sf_dir):
    numbers = F.array_join(F.array_repeat(F.lit("40 20 -3 120"), F.length("seq").cast("int")), " ")
    lines = short_reads(spark, sf_dir).select("n", F.concat_ws("\n", F.concat(F.lit("@r"), "doc_id"), "seq", F.lit("+"), numbers).alias("value"))
    return reads.scan(spark, text_file(lines, "fastq"), "fastq", scale="integers").select("rdid", "qual")


@query(
    f"WITH {_SHORT}, q AS (SELECT *, {_PATTERN.format('I5+!?')} AS qual, reverse(seq) AS other FROM short) SELECT n AS rdid, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS mate, 'x' || doc_id AS name, seq, qual FROM q "
    "UNION ALL SELECT n, 2, CASE WHEN doc_id % 3 = 1 THEN 'x' ELSE 'y' END || doc_id, other, reverse(qual) FROM q WHERE doc_id % 3 > 0"
)
def tabbed_scan(spark, sf_dir):
    rows, q, name = short_reads(spark, sf_dir), quality("I5+!?"), F.concat(F.lit("x"), "doc_id")
    one, other = [name, F.col("seq"), q], [F.reverse("seq"), F.reverse(q)]
    line = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("\t", *one)).when(F.col("doc_id") % 3 == 1, F.concat_ws("\t", *one, *other)).otherwise(F.concat_ws("\t", *one, F.concat(F.lit("y"), "doc_id"), *other))
    return longs(reads.scan(spark, text_file(rows.select("n", line.alias("value")), "tabbed"), "tab5").select("rdid", "mate", "name", "seq", "qual"), "mate")


@query(f"WITH {_SHORT} SELECT n AS rdid, 'm_1_2_3_4_' || doc_id || '_0/1' AS name, seq, {_PATTERN.format('I5+!?')} AS qual, CAST(doc_id % 2 AS VARCHAR) AS filter, doc_id % 2 <> 0 AS qc FROM short")
def qseq_scan(spark, sf_dir):
    from ..operators.filters import qc_ok

    fields = [*map(F.lit, "m 1 2 3 4".split()), F.col("doc_id").cast("string"), F.lit("0"), F.lit("1"), F.replace(F.col("seq"), F.lit("N"), F.lit(".")), quality("I5+!?"), (F.col("doc_id") % 2).cast("string")]
    path = text_file(short_reads(spark, sf_dir).select("n", F.concat_ws("\t", *fields).alias("value")), "qseq")
    return reads.scan(spark, path, "qseq").select("rdid", "name", "seq", "qual", "filter", qc_ok(F.col("filter")).alias("qc"))


@query(f"WITH {_SHORT} SELECT n AS rdid, CAST(n AS VARCHAR) AS name, seq, {_CONST} AS qual FROM short WHERE n % 5 <> 4")
def raw_scan(spark, sf_dir):
    """Every fifth line is blank: it gives no read, but counts."""
    line = F.when(F.col("n") % 5 == 4, "  ").otherwise(F.lower("seq"))
    return reads.scan(spark, text_file(short_reads(spark, sf_dir).select("n", line.alias("value")), "raw"), "raw").select("rdid", "name", "seq", "qual")


@query("SELECT CAST(r AS BIGINT) AS rdid, CAST(r AS VARCHAR) AS name, s AS seq, repeat('I', length(s)) AS qual FROM (VALUES (0, 'ACGT'), (1, 'GGN'), (2, 'T')) v(r, s)")
def literal_scan(spark, sf_dir):
    return reads.literal(spark, ["acgt", "GGN", "t"]).select("rdid", "name", "seq", "qual")


@query(f"WITH {_SHORT} SELECT n AS rdid, seq, substring(repeat('!&+0', length(seq)), 1, length(seq)) AS qual FROM short")
def quality_file_scan(spark, sf_dir):
    rows = short_reads(spark, sf_dir).select("n", F.concat(F.lit("b"), "doc_id").alias("chrom"), F.col("n").alias("chrom_id"), "seq")
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda k: (k % 4 * 5).cast("string")), " ")
    fasta = text_file(sinks.fasta_text(rows, 60).withColumnRenamed("chrom_id", "n"), "fasta")
    quals = text_file(rows.select("n", F.concat(F.lit(">"), "chrom", F.lit("\n"), numbers).alias("value")), "quals")
    return reads.with_quality_file(reads.fasta(spark, fasta), spark, quals).select("rdid", "seq", "qual")


@query(f"WITH {_SHORT} SELECT n // 2 AS rdid, n % 2 + 1 AS mate, 'r' || doc_id AS name FROM short")
def interleaved_scan(spark, sf_dir):
    return longs(reads.interleaved(reads.fastq(spark, fastq_file(short_reads(spark, sf_dir), "I"))).select("rdid", "mate", "name"), "rdid", "mate")


@query(f"WITH {_SHORT} SELECT n AS rdid, 1 AS mate, seq FROM short UNION ALL SELECT n, 2, translate(reverse(seq), 'ACGT', 'TGCA') FROM short")
def paired_scan(spark, sf_dir):
    from ..functions.seq import reverse_complement

    rows = short_reads(spark, sf_dir)
    two = rows.withColumn("seq", reverse_complement("seq"))
    return reads.paired(reads.fastq(spark, fastq_file(rows, "I")), reads.fastq(spark, fastq_file(two, "I"))).select("rdid", F.col("mate").cast("long").alias("mate"), "seq")


# ---- references and annotations -----------------------------------------------------------------


@query(f"WITH {_NREF} SELECT row_number() OVER (ORDER BY item_id) - 1 AS chrom_id, chrom, CAST(length(seq) AS BIGINT) AS len, seq FROM nref")
def reference_scan(spark, sf_dir):
    """Letters that are no bases become N; a record's lines are joined."""
    rows = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), F.concat(F.lit(">b"), "item_id", F.lit(" more\n"), F.regexp_replace(F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", "n"), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"), "(.{50})(?=.)", "$1\n")).alias("value"))
    # n and v stand for different bases by their index, so unknown places are marked before
    masked = named_ref(spark, sf_dir).select(F.col("chrom_id").alias("n"), F.concat(F.lit(">"), "chrom", F.lit(" more\n"), F.regexp_replace(F.translate("seq", "ACGTN", "acgTx"), "(.{50})(?=.)", "$1\n")).alias("value"))
    return annotations.reference(spark, text_file(masked.join(rows.select("n"), "n"), "ref")).select("chrom_id", "chrom", "len", "seq")


@query(f"WITH {_NREF}, q AS (SELECT event_id, 'b' || (event_id % (SELECT count(*) FROM benchmark)) AS chrom, event_id % 300 AS pos, 5 + event_id % 9 AS len FROM events) SELECT event_id, substring(seq, CAST(pos AS BIGINT) + 1, CAST(len AS BIGINT)) AS bases FROM q JOIN nref USING (chrom)")
def reference_access(spark, sf_dir):
    n = t(spark, sf_dir, "benchmark").count()
    places = t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("b"), F.col("event_id") % n).alias("chrom"), (F.col("event_id") % 300).alias("pos"), (5 + F.col("event_id") % 9).alias("len"))
    return annotations.reference_windows(places, named_ref(spark, sf_dir)).select("event_id", "bases")


#: Candidate variants on benchmark: places up to 400, three types, some that do not fit.
_CAND = (
    "cand AS (SELECT 'v' || l_orderkey || '_' || l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'deletion' ELSE 'insertion' END AS type, 'b' || (l_partkey % 60) AS chrom, CAST(l_suppkey * 7 % 400 AS BIGINT) AS pos, "
    "CASE l_linenumber % 3 WHEN 0 THEN substring('ACGTN', CAST(l_quantity AS INTEGER) % 5 + 1, 1) WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) % 6 AS VARCHAR) ELSE repeat('AC', CAST(l_quantity AS INTEGER) % 20) END AS data FROM lineitem)"
)
_FITTING = (
    f"{_NREF}, {_CAND}, w AS (SELECT c.*, seq, CASE type WHEN 'deletion' THEN CAST(data AS BIGINT) ELSE 1 END AS width FROM cand c JOIN nref USING (chrom)), "
    "fit AS (SELECT id, type, chrom, pos, data FROM w WHERE pos + width <= length(seq) AND position('N' IN substring(seq, CAST(greatest(pos, 1) AS BIGINT), CAST(width + CASE WHEN pos > 0 THEN 2 ELSE 1 END AS BIGINT))) = 0 AND "
    "((type = 'single' AND data <> 'N' AND substring(seq, pos + 1, 1) <> data) OR (type = 'deletion' AND width > 0) OR (type = 'insertion' AND length(data) BETWEEN 1 AND 32)))"
)


def candidates_of(spark, sf_dir) -> DataFrame:
    n, q = F.col("l_linenumber") % 3, F.col("l_quantity").cast("int")
    return t(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("v"), "l_orderkey", F.lit("_"), "l_linenumber").alias("id"),
        F.when(n == 0, "single").when(n == 1, "deletion").otherwise("insertion").alias("type"),
        F.concat(F.lit("b"), F.col("l_partkey") % 60).alias("chrom"),
        (F.col("l_suppkey") * 7 % 400).alias("pos"),
        F.when(n == 0, F.substring(F.lit("ACGTN"), q % 5 + 1, F.lit(1))).when(n == 1, (q % 6).cast("string")).otherwise(F.repeat(F.lit("AC"), q % 20)).alias("data"),
    )


def fitting_of(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "snps")
    sinks.write_tsv(candidates_of(spark, sf_dir).where("data <> ''"), path)
    return annotations.variants(spark, path, named_ref(spark, sf_dir))


@query(f"WITH {_FITTING} SELECT * FROM fit")
def variant_scan(spark, sf_dir):
    return fitting_of(spark, sf_dir)


@query(f"WITH {_FITTING} SELECT 'ht_' || id AS hid, chrom, pos AS \"left\", CASE WHEN type = 'deletion' THEN pos + CAST(data AS BIGINT) - 1 ELSE pos END AS \"right\", id AS ids FROM fit")
def default_haplotypes(spark, sf_dir):
    return sinks.haplotype_lines(annotations.haplotypes(spark, None, fitting_of(spark, sf_dir)))


@query(
    f"WITH {_FITTING}, h AS (SELECT 'h' || l_orderkey AS hid, 'b' || (l_orderkey % 60) AS chrom, l_orderkey % 400 AS l, l_orderkey % 400 + 9 AS r, l_linenumber AS k, 'v' || l_orderkey || '_' || l_linenumber AS id FROM lineitem) "
    "SELECT hid, chrom, l AS \"left\", r AS \"right\", string_agg(id, ',' ORDER BY k) AS ids FROM h WHERE id IN (SELECT id FROM fit) GROUP BY ALL"
)
def haplotype_scan(spark, sf_dir):
    """Lists of ids, those left out that are not variants; a haplotype without any is dropped."""
    snps = written(fitting_of(spark, sf_dir), "fitting")
    every = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("k"))
    ids = F.array_join(F.transform("k", lambda k: F.concat(F.lit("v"), F.col("l_orderkey"), F.lit("_"), k)), ",")
    lines = every.select(F.concat(F.lit("h"), "l_orderkey"), F.concat(F.lit("b"), F.col("l_orderkey") % 60), F.col("l_orderkey") % 400, F.col("l_orderkey") % 400 + 9, ids.alias("ids"))
    path = scratch(spark, "haplotypes")
    sinks.write_tsv(lines, path)
    return sinks.haplotype_lines(annotations.haplotypes(spark, path, snps))


_SITE_ROWS = "site AS (SELECT 'b' || (l_partkey % 60) AS chrom, CAST(l_suppkey * 3 % 250 AS BIGINT) AS l, CAST(l_suppkey * 3 % 250 + CAST(l_quantity AS INTEGER) * 4 - 8 AS BIGINT) AS r, CASE WHEN l_partkey % 60 % 2 = 0 THEN '+' ELSE '.' END AS strand FROM lineitem)"
_SITES_FIT = f"{_NREF}, {_SITE_ROWS}, ok AS (SELECT DISTINCT chrom, l, r, strand = '+' AS fw FROM site JOIN nref USING (chrom) WHERE l < r AND r < length(seq) AND substring(seq, l + 1, 1) <> 'N' AND substring(seq, r + 1, 1) <> 'N')"


def site_file(spark, sf_dir) -> str:
    left = F.col("l_suppkey") * 3 % 250
    rows = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("b"), F.col("l_partkey") % 60), left, left + F.col("l_quantity").cast("int") * 4 - 8, F.when(F.col("l_partkey") % 60 % 2 == 0, "+").otherwise("."))
    path = scratch(spark, "sites")
    sinks.write_tsv(rows, path)
    return path


@query(f"WITH {_SITES_FIT} SELECT chrom, l AS \"left\", r AS \"right\", fw FROM ok")
def splice_site_scan(spark, sf_dir):
    return annotations.splice_sites(spark, site_file(spark, sf_dir), named_ref(spark, sf_dir))


@query(f"WITH {_SITES_FIT} SELECT chrom, l AS \"left\", r AS \"right\", fw FROM ok")
def exon_scan(spark, sf_dir):
    return annotations.exons(spark, site_file(spark, sf_dir), named_ref(spark, sf_dir))


@query(f"WITH {_SITE_ROWS} SELECT DISTINCT chrom, l AS \"left\", r AS \"right\", strand = '+' AS fw FROM site WHERE l < r")
def known_site_scan(spark, sf_dir):
    return annotations.splice_sites(spark, site_file(spark, sf_dir))


@query(
    f"WITH {_SITES_FIT} SELECT 'splice' AS kind, chrom, l AS \"left\", r AS \"right\", CASE WHEN fw THEN '+' ELSE '-' END AS strand FROM ok WHERE l % 3 > 0 UNION ALL SELECT 'every', chrom, l, r, CASE WHEN fw THEN '+' ELSE '-' END FROM ok "
    "UNION ALL SELECT 'exon', chrom, l, r, CASE WHEN fw THEN '+' ELSE '-' END FROM ok"
)
def index_sites(spark, sf_dir):
    """Splice sites and exons of a written index: those not taken from exons, all, and the exons."""
    sites = annotations.splice_sites(spark, site_file(spark, sf_dir), named_ref(spark, sf_dir))
    alts = sites.select(F.explode(F.array(F.lit("splice"), F.lit("exon"))).alias("type"), "*").withColumn("excluded", F.col("left") % 3 == 0)
    ref = ref_of(spark, sf_dir)
    path = scratch(spark, "index")
    index.write_index(path, ref, index.kmer_index(ref, K), alts=alts)
    got = index.load_index(spark, path, "alts")["alts"]
    parts = {"splice": sinks.index_splice_sites(got), "every": sinks.index_splice_sites(got, every=True), "exon": sinks.index_exons(got)}
    out = [df.select(F.lit(k).alias("kind"), *df.columns) for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query(f"WITH {REF}, idx AS (SELECT item_id, p AS pos, substring(seq, p + 1, {K}) AS kmer FROM (SELECT item_id, seq, unnest(range(0, length(seq) - {K - 1})) AS p FROM ref WHERE length(seq) >= {K})) SELECT item_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places, count(DISTINCT kmer) AS kinds FROM idx GROUP BY item_id")
def index_round_trip(spark, sf_dir):
    ref = ref_of(spark, sf_dir)
    path = scratch(spark, "index")
    index.write_index(path, ref, index.kmer_index(ref, K))
    kmers = index.load_index(spark, path)["kmers"]
    return kmers.groupBy(F.col("chrom_id").cast("long").alias("item_id")).agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.countDistinct("kmer").alias("kinds"))


@query(f"WITH {_NREF}, a AS (SELECT count(*) AS variants FROM region), k AS (SELECT substring(seq, p + 1, {K}) AS kmer FROM (SELECT seq, unnest(range(0, length(seq) - {K - 1})) AS p FROM nref WHERE length(seq) >= {K})), g AS (SELECT kmer FROM k WHERE position('N' IN kmer) = 0) SELECT (SELECT count(*) FROM nref) AS sequences, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM nref) AS bases, (SELECT CAST(sum(length(seq) - length(replace(seq, 'N', ''))) AS BIGINT) FROM nref) AS unknown, (SELECT count(*) FROM g) AS kmers, (SELECT count(DISTINCT kmer) FROM g) AS distinct_kmers, variants FROM a")
def index_inspection(spark, sf_dir):
    ref = named_ref(spark, sf_dir)
    return sinks.index_summary(ref, index.kmer_index(ref, K), t(spark, sf_dir, "region"))


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS chrom_id, 'b' || item_id AS chrom FROM benchmark")
def index_names(spark, sf_dir):
    ref = numbered(named_ref(spark, sf_dir).drop("chrom_id").withColumn("_o", F.substring("chrom", 2, 99).cast("long")), "_o").withColumnRenamed("n", "chrom_id")
    return sinks.index_names(ref)


@query(
    "WITH e AS (SELECT 'c' || (l_orderkey % 50) AS chrom, l_linenumber % 2 AS odd, CAST(l_suppkey AS BIGINT) AS l, CAST(l_suppkey + CAST(l_quantity AS INTEGER) - 2 AS BIGINT) AS r, l_orderkey, l_linenumber FROM lineitem) "
    "SELECT chrom, l AS \"left\", r AS \"right\", '+' AS strand, 'g' || (l_orderkey % 500) AS gene_id, 't' || l_orderkey AS transcript_id FROM e WHERE odd = 1 AND l < r AND l_orderkey % 7 > 0"
)
def gtf_scan(spark, sf_dir):
    """Exon lines with both ids and left < right; comments, other features and lines without a transcript are left out."""
    left = F.col("l_suppkey")
    feature = F.when(F.col("l_linenumber") % 2 == 1, "exon").otherwise("CDS")
    ids = F.concat(F.lit('gene_id "g'), F.col("l_orderkey") % 500, F.lit('";'), F.when(F.col("l_orderkey") % 7 > 0, F.concat(F.lit(' transcript_id "t'), "l_orderkey", F.lit('"; level 2;'))).otherwise(""))
    fields = [F.concat(F.lit("c"), F.col("l_orderkey") % 50), F.lit("x"), feature, left.cast("string"), (left + F.col("l_quantity").cast("int") - 2).cast("string"), F.lit("."), F.lit("+"), F.lit("."), ids]
    lines = t(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *fields).alias("value"))
    path = scratch(spark, "gtf")
    lines.union(spark.range(1).select(F.lit("#!comment"))).write.text(path)
    return annotations.gtf_exons(spark, path)


_VCF = (
    "a AS (SELECT p_partkey, 'c' || (p_partkey % 9) AS chrom, CAST(p_partkey * 10 AS BIGINT) AS pos, translate(substring(upper(p_name), 1, 1 + CAST(p_size % 3 AS INTEGER)), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTACA') AS ref, "
    "translate(substring(upper(p_name), 1, 1 + CAST(p_partkey % 4 AS INTEGER)), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTACA') AS alt FROM part)"
)


def vcf_file(spark, sf_dir) -> str:
    base = lambda c: F.translate(F.substring(F.upper("p_name"), F.lit(1), c), "BDEFHIJKLMNOPQRSUVWXYZ ", "ACGTACGTACGTACGTACGTACA")
    ref, alt = base(F.lit(1) + (F.col("p_size") % 3).cast("int")), base(F.lit(1) + (F.col("p_partkey") % 4).cast("int"))
    info = F.concat(F.lit("AF=0.1;CLNSIG="), (F.col("p_partkey") % 6).cast("string"), F.lit(";GENE=g"), (F.col("p_partkey") % 20).cast("string"))
    fields = [F.concat(F.lit("c"), F.col("p_partkey") % 9), (F.col("p_partkey") * 10 + 1).cast("string"), F.concat(F.lit("rs"), "p_partkey"), ref, F.concat(alt, F.lit(",T")), F.lit("."), F.lit("PASS"), info, F.lit("GT:DP"), F.lit("0|1:3"), F.lit("1|1:9")]
    path = scratch(spark, "vcf")
    t(spark, sf_dir, "part").select(F.concat_ws("\t", *fields).alias("value")).union(spark.range(1).select(F.lit("##fileformat=VCFv4.2"))).write.text(path)
    return path


@query(f"WITH {_VCF} SELECT chrom, pos, 'rs' || p_partkey AS id, ref, alt || ',T' AS alts, '0|1/1|1' AS genotypes FROM a")
def vcf_scan(spark, sf_dir):
    return annotations.vcf(spark, vcf_file(spark, sf_dir)).select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), F.array_join("genotypes", "/").alias("genotypes"))


@query(f"WITH {_VCF} SELECT 'g' || (p_partkey % 20) AS gene, chrom, min(pos) - 100 AS \"left\", max(pos) + 100 AS \"right\" FROM a WHERE p_partkey % 6 IN (4, 5) GROUP BY ALL")
def clinical_ranges(spark, sf_dir):
    rows = annotations.clinical(annotations.vcf(spark, vcf_file(spark, sf_dir)))
    return annotation.gene_range(rows.withColumn("gene", F.regexp_extract("info", r"GENE=([^;]*)", 1)))


@query(
    "WITH s AS (SELECT p_partkey AS k, 'rs' || (p_partkey % 1500) AS id, 'c' || (p_partkey % 9) AS chrom, CAST(p_size * 10 AS BIGINT) AS pos, CASE p_partkey % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'deletion' WHEN 2 THEN 'insertion' ELSE 'mixed' END AS type, p_size % 3 AS width, p_partkey % 5 AS allele, p_size % 2 = 0 AS fw FROM part), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM s WHERE type <> 'mixed' AND k % 11 > 0) "
    "SELECT id, chrom, pos, pos + width AS \"end\", type, CASE WHEN fw THEN 'A/' || substring('ACGT-', CAST(allele AS INTEGER) + 1, 1) ELSE 'T/' || translate(substring('ACGT-', CAST(allele AS INTEGER) + 1, 1), 'ACGT', 'TGCA') END AS alleles FROM f "
    "WHERE n = 1 AND ((type = 'single' AND width = 1) OR (type = 'deletion' AND width > 0) OR (type = 'insertion' AND width = 0)) AND (fw OR translate(substring('ACGT-', CAST(allele AS INTEGER) + 1, 1), 'ACGT', 'TGCA') = 'A' OR (type = 'insertion' AND allele = 4))"
)
def dbsnp_scan(spark, sf_dir):
    """Rows of 26 fields; genomic ones of three classes, the first of each id, consistent in class and length, with the reference among the alleles of the forward strand."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 4 == 0, "single").when(k % 4 == 1, "deletion").when(k % 4 == 2, "insertion").otherwise("mixed")
    allele = F.substring(F.lit("ACGT-"), (k % 5).cast("int") + 1, F.lit(1))
    zero = F.lit("0")
    fields = [zero, F.concat(F.lit("c"), k % 9), (size * 10).cast("string"), (size * 10 + size % 3).cast("string"), F.concat(F.lit("rs"), k % 1500), zero, F.when(size % 2 == 0, "+").otherwise("-"), F.lit("A"), zero, F.concat(F.lit("A/"), allele), F.when(k % 11 > 0, "genomic").otherwise("cDNA"), kind, *[zero] * 12, F.lit("0.5,0.5,"), zero]
    path = text_file(t(spark, sf_dir, "part").select(k.alias("n"), F.concat_ws("\t", *fields).alias("value")), "dbsnp")
    return annotations.dbsnp(spark, path).select("id", "chrom", "pos", "end", "type", F.array_join("alleles", "/").alias("alleles"))


@query(
    "WITH h AS (SELECT l_orderkey AS rep, 'b' || (l_suppkey % 9) AS chrom, CAST(l_partkey AS BIGINT) AS pos, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem WHERE l_orderkey % 10 = 0) "
    "SELECT 'rpt_' || rep AS name, 'rep' AS rep, CAST(0 AS BIGINT) AS pos, rep % 40 + 30 AS len, chrom, h.pos AS at, strand FROM h"
)
def repeat_info_scan(spark, sf_dir):
    """What repeat_files writes, as repeat_info reads it."""
    place = F.struct(F.concat(F.lit("b"), F.col("l_suppkey") % 9).alias("chrom_id"), F.col("l_partkey").alias("pos"), (F.col("l_linenumber") % 2 == 0).alias("fw"))
    reps = t(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0").groupBy(F.col("l_orderkey").alias("rep_id")).agg(F.collect_list(place).alias("positions"))
    reps = reps.withColumn("consensus", F.repeat(F.lit("A"), (F.col("rep_id") % 40 + 30).cast("int")))
    path = scratch(spark, "repeats")
    sinks.repeat_files(reps)[1].select("value").write.text(path)
    return annotations.repeat_info(spark, path).select("name", "rep", "pos", "len", F.explode("positions").alias("p")).select("name", "rep", "pos", "len", "p.chrom", F.col("p.pos").alias("at"), "p.strand")


_SAM = (
    "s AS (SELECT 'q' || l_orderkey || '_' || l_linenumber AS qname, CAST(CASE WHEN l_linenumber % 4 = 0 THEN 4 ELSE l_linenumber % 2 * 16 END AS INTEGER) AS flag, l_linenumber % 4 > 0 AS mapped, 'b' || (l_suppkey % 9) AS chrom, CAST(l_partkey AS BIGINT) AS pos, "
    "CAST(l_quantity AS BIGINT) AS q, l_orderkey FROM lineitem)"
)


def alignments_table(spark, sf_dir) -> DataFrame:
    """lineitem as records: the fourth line of an order is unmapped."""
    mapped = F.col("l_linenumber") % 4 > 0
    q = F.col("l_quantity").cast("long")
    cigar = F.concat(q.cast("string"), F.lit("M20N"), (q + 5).cast("string"), F.lit("M2D3M1I4M"))
    return t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("rdid"), F.lit(0).alias("mate"), F.col("l_linenumber").cast("int").alias("rank"), F.concat(F.lit("q"), "l_orderkey", F.lit("_"), "l_linenumber").alias("qname"),
        F.when(~mapped, 4).otherwise(F.col("l_linenumber") % 2 * 16).cast("int").alias("flag"), F.when(mapped, F.concat(F.lit("b"), F.col("l_suppkey") % 9)).alias("chrom"), F.when(mapped, F.col("l_partkey")).alias("pos"),
        F.when(mapped, F.lit(60)).alias("mapq"), F.when(mapped, cigar).alias("cigar"), F.lit(None).cast("string").alias("mate_chrom"), F.lit(None).cast("long").alias("mate_pos"), F.lit(0).alias("tlen"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"),
        sinks.tags(AS=F.when(mapped, -q), NM=F.when(mapped, q % 3), YT=F.lit("UU")).alias("tags"),
    )


@query(
    f"WITH {_SAM} SELECT qname, flag, CASE WHEN mapped THEN chrom ELSE '*' END AS chrom, CASE WHEN mapped THEN pos END AS pos, CASE WHEN mapped THEN pos + 2 * q + 33 END AS \"end\", CASE WHEN mapped THEN CAST(-q AS VARCHAR) END AS score, 'UU' AS class, "
    "CASE WHEN mapped THEN pos + q - 1 END AS jl, CASE WHEN mapped THEN pos + q + 20 END AS jr FROM s"
)
def sam_scan(spark, sf_dir):
    """Records written as text and scanned: places, ends by CIGAR, tags, junctions."""
    from ..functions.cigar import cigar_junctions

    path = scratch(spark, "sam")
    rows = alignments_table(spark, sf_dir)
    sinks.write_sam(path, sinks.sam_header(named_ref(spark, sf_dir)), sinks.sam_records(rows))
    got = annotations.sam(spark, f"{path}/*")
    j = F.try_element_at(cigar_junctions(F.col("pos"), F.col("cigar")), F.lit(1))
    return got.select("qname", "flag", "chrom", "pos", "end", F.col("tags")["AS"].alias("score"), F.col("tags")["YT"].alias("class"), j["left"].alias("jl"), j["right"].alias("jr"))


@query(f"WITH {_SAM} SELECT qname FROM s WHERE mapped")
def mapped_records(spark, sf_dir):
    """Without records of unmapped reads."""
    lines = sinks.sam_records(alignments_table(spark, sf_dir), Options(no_unal=True))
    return lines.select(F.split("value", "\t")[0].alias("qname"))


@query(f"WITH {_SAM}, r AS (SELECT qname, row_number() OVER (ORDER BY l_orderkey, CAST(split_part(qname, '_', 2) AS INTEGER)) - 1 AS n FROM s) SELECT qname, n FROM r")
def ordered_records(spark, sf_dir):
    """The number of each record's line in the ordered output."""
    lines = sinks.ordered(sinks.sam_records(alignments_table(spark, sf_dir)))
    return reads.with_ordinal(lines.select(F.split("value", "\t")[0].alias("qname")), "n")


@query(
    f"WITH {_NREF} SELECT '@HD\tVN:1.0\tSO:unsorted' AS value UNION ALL SELECT '@SQ\tSN:' || chrom || '\tLN:' || length(seq) FROM nref UNION ALL SELECT '@RG\tID:a\tSM:x' UNION ALL SELECT '@PG\tID:seqloom\tPN:seqloom\tVN:0.1'"
)
def sam_header_lines(spark, sf_dir):
    return sinks.sam_header(named_ref(spark, sf_dir), Options(rg_id="a", rg=("SM:x",))).select("value")


_ROUTE = "r AS (SELECT o_orderkey AS rdid, o_custkey % 2 = 1 AS paired, o_orderkey % 3 > 0 AS mapped, o_orderkey % 5 = 0 AS proper, o_orderkey % 7 = 0 AS disc FROM orders)"


@query(
    f"WITH {_ROUTE} SELECT 'un' AS kind, rdid FROM r WHERE NOT paired AND NOT mapped UNION ALL SELECT 'al', rdid FROM r WHERE NOT paired AND mapped UNION ALL SELECT 'un_conc', rdid FROM r WHERE paired AND NOT proper UNION ALL SELECT 'al_conc', rdid FROM r WHERE paired AND proper "
    "UNION ALL SELECT 'al_conc_disc', rdid FROM r WHERE paired AND (proper OR disc)"
)
def routed_reads(spark, sf_dir):
    """Reads by how they aligned; records with bit 256 do not count."""
    o = t(spark, sf_dir, "orders")
    k, paired = F.col("o_orderkey"), F.col("o_custkey") % 2
    flag = (paired + F.when(k % 3 == 0, 4).otherwise(0) + F.when((paired == 1) & (k % 5 == 0), 2).otherwise(0)).cast("int")
    first = o.select(k.alias("rdid"), flag.alias("flag"), F.when(k % 7 == 0, "DP").otherwise("CP").alias("yt"))
    second = first.select("rdid", F.lit(256).alias("flag"), F.lit("DP").alias("yt"))
    # one pass for all kinds: five joins in a union would get few, large tasks
    return sinks.routed(o.select(k.alias("rdid")), first.union(second)).select(F.explode("kinds").alias("kind"), "rdid")


@query("SELECT n_nationkey, regexp_replace('chr' || n_name, '^chr', '') AS bare, 'chr' || n_name AS full FROM nation")
def chromosome_names(spark, sf_dir):
    from ..functions.seq import chrom_name

    rows = t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("chr"), "n_name").alias("long"))
    return rows.select("n_nationkey", chrom_name("long", remove=True).alias("bare"), chrom_name("n_name", add=True).alias("full"))


_CLASSES = "c AS (SELECT o_custkey % 2 = 1 AS paired, o_orderkey % 4 AS n, o_orderkey % 3 AS n1, o_custkey % 3 AS n2, CASE WHEN o_orderkey % 5 < 2 THEN 'concordant' WHEN o_orderkey % 5 = 2 THEN 'discordant' ELSE 'unpaired' END AS category FROM orders)"


@query(
    f"WITH {_CLASSES}, m AS (SELECT count(*) AS nread, count(*) FILTER (paired) AS np, count(*) FILTER (NOT paired) AS nu, count(*) FILTER (paired AND category = 'concordant') AS conc, count(*) FILTER (paired AND category = 'concordant' AND n = 1) AS c1, count(*) FILTER (paired AND category = 'discordant') AS disc, "
    "count(*) FILTER (paired AND category = 'unpaired' AND n1 = 1) + count(*) FILTER (paired AND category = 'unpaired' AND n2 = 1) AS m1, count(*) FILTER (paired AND category = 'unpaired' AND n1 > 1) + count(*) FILTER (paired AND category = 'unpaired' AND n2 > 1) AS m2, "
    "count(*) FILTER (NOT paired AND n = 1) AS u1, count(*) FILTER (NOT paired AND n > 1) AS u2 FROM c), r AS (SELECT *, 100.0 * (2 * (conc + disc) + m1 + m2 + u1 + u2) / (nu + 2 * np) AS rate FROM m) "
    "SELECT nread || ' reads; of these:' AS line FROM r UNION ALL SELECT '  ' || np || ' (' || printf('%.2f', 100.0 * np / nread) || '%) were paired; of these:' FROM r UNION ALL SELECT printf('%.2f', rate) || '% overall alignment rate' FROM r "
    "UNION ALL SELECT chr(9) || 'Overall alignment rate: ' || printf('%.2f', rate) || '%' FROM r"
)
def summary_lines(spark, sf_dir):
    """First two lines and last line of the summary, and the last line of the tabbed form."""
    o = t(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 5 < 2, "concordant").when(k % 5 == 2, "discordant").otherwise("unpaired")
    m = metrics.reporting(o.select((c % 2 == 1).alias("paired"), kind.alias("category"), (k % 4).alias("n"), (k % 3).alias("n1"), (c % 3).alias("n2"))).first()
    lines = metrics.summary_text(m).splitlines()
    last = metrics.summary_text(m, new=True).splitlines()[-1]
    values = F.array(*map(F.lit, [*lines[:2], lines[-1], last]))
    return spark.range(1).select(F.explode(values).alias("line"))


@query("WITH s AS (SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS step, count(*) AS n FROM orders GROUP BY 1) SELECT step, n, CAST(sum(n) OVER (ORDER BY step) AS BIGINT) AS total FROM s")
def progress_rows(spark, sf_dir):
    return sinks.metrics_rows(t(spark, sf_dir, "orders"), "o_orderkey", 1000)


@query(
    f"WITH {_VARIANTS}, {_DEDUP}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS c, row_number() OVER (PARTITION BY id ORDER BY {_VORDER} NULLS FIRST) - 1 AS k FROM d) "
    "SELECT CASE WHEN c > 1 THEN id || '.' || k ELSE CAST(id AS VARCHAR) END AS id, CASE type WHEN 'S' THEN 'single' WHEN 'D' THEN 'deletion' ELSE 'insertion' END AS type, chrom, pos, data FROM n"
)
def snp_file_lines(spark, sf_dir):
    return sinks.snp_lines(annotation.suffix_ids(annotation.distinct_variants(variants_of(spark, sf_dir))))


@query("SELECT * FROM (VALUES ('index', 1, 0.5), ('align', 2, 1.5), ('align', 3, 2.5)) v(name, run, seconds)")
def results_rows(spark, sf_dir):
    """Two appends to a results table."""
    path, schema = scratch(spark, "results"), "name string, run int, seconds double"
    sinks.results_table(spark, path, [("index", 1, 0.5)], schema)
    return sinks.results_table(spark, path, [("align", 2, 1.5), ("align", 3, 2.5)], schema)


@query(f"WITH {REF} SELECT item_id AS chrom_id, '>b' || item_id || chr(10) || regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g') AS value FROM ref WHERE length(seq) % 60 > 0")
def fasta_lines(spark, sf_dir):
    rows = ref_of(spark, sf_dir).where("length(seq) % 60 > 0").withColumn("chrom", F.concat(F.lit("b"), "chrom_id"))
    return sinks.fasta_text(rows, 60)


__all__ = ["READS", "alignments_table", "named_ref", "numbered", "reads_of", "short_reads"]
