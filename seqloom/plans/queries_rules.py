"""Queries of filters, scalar functions, joins, kernels, ranking, metrics, repeats and the embedding interface, each with SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar, sam, scoring, seq
from ..functions.config import LengthFunction, Options, RepeatOptions, Scoring
from ..operators import annotation, evaluate, filters, index, intervals, kernels, metrics, pairing, ranking, repeats, simulate, variants
from ..sources.scratch import scratch, written
from .queries_io import _FITTING, _NREF, _SHORT, fitting_of, named_ref, short_reads
from .registry import _MAP, BASE, READS, REF, hits_of, longs, query, reads_of, ref_of, spread, t
from .session import Index, register

# ---- filters ------------------------------------------------------------------------------------

_MASK = "translate(regexp_replace(lower(text), '[^a-z]', 'N', 'g'), 'abcdefghijklmnopqrstuvwxyz', '" + ("ACGT" * 7)[:26] + "')"


def masked_reads(spark, sf_dir) -> DataFrame:
    """Documents as reads of 0 to 39 bases, with unknown ones, in pairs by number."""
    masked = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", "N"), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])
    d = F.col("doc_id")
    return t(spark, sf_dir, "documents").select("doc_id", F.floor(d / 2).alias("rdid"), (d % 2 + 1).cast("int").alias("mate"), F.substring(masked, F.lit(1), (d % 40).cast("int")).alias("seq"), (d % 3).cast("string").alias("filter"))


_READS40 = f"r AS (SELECT doc_id, doc_id // 2 AS rdid, doc_id % 2 + 1 AS mate, substring({_MASK}, 1, doc_id % 40) AS seq, CAST(doc_id % 3 AS VARCHAR) AS filter FROM documents), c AS (SELECT *, length(seq) AS len, length(seq) - length(replace(seq, 'N', '')) AS n FROM r)"


@query("SELECT true AS whole, true AS near, true AS again")
def read_sample(spark, sf_dir):
    """A quarter of the reads: mates stay together, the share is near, and a rerun gives the same."""
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rdid"), "l_linenumber")
    kept = filters.sample(rows, 0.25, 7)
    per = rows.groupBy("rdid").agg(F.count("*").alias("n")).join(kept.groupBy("rdid").agg(F.count("*").alias("k")), "rdid", "left")
    twice = kept.exceptAll(filters.sample(rows.repartition(3), 0.25, 7)).agg((F.count("*") == 0).alias("again"))
    return per.agg(F.bool_and(F.coalesce(F.col("n") == F.col("k"), F.lit(True))).alias("whole"), (F.abs(F.count("k") / F.count("*") - 0.25) < 0.03).alias("near")).crossJoin(F.broadcast(twice))


@query(f"WITH {_READS40} SELECT doc_id, n <= trunc(0.15 * len) AS alone, sum(n) OVER (PARTITION BY rdid) <= trunc(0.15 * sum(len) OVER (PARTITION BY rdid)) AS joined FROM c")
def pair_n_filter(spark, sf_dir):
    rows = masked_reads(spark, sf_dir)
    alone = filters.pair_n_filter(rows).withColumnRenamed("n_ok", "alone")
    return filters.pair_n_filter(alone, concatenated=True).select("doc_id", "alone", F.col("n_ok").alias("joined"))


@query(f"WITH {_READS40} SELECT doc_id, CASE WHEN len < 2 THEN 'LN' WHEN n > trunc(0.15 * len) THEN 'NS' WHEN 0 < trunc(0.05 * len) THEN 'SC' WHEN filter = '0' THEN 'QC' END AS yf FROM c")
def filter_reasons(spark, sf_dir):
    o = Options(qc_filter=True, scoring=replace(Scoring(), min_score=LengthFunction("L", 0.0, 0.05)))
    return filters.filtered(masked_reads(spark, sf_dir), o).select("doc_id", "yf")


@query(
    f"WITH {_READS40}, s AS (SELECT doc_id, mate, unnest([true, false]) AS fw FROM c) SELECT doc_id, fw, 'nofw' AS kind FROM s WHERE fw = (mate = 2) UNION ALL SELECT doc_id, fw, 'norc' FROM s WHERE fw <> (mate = 2) UNION ALL SELECT doc_id, fw, 'ff' FROM s WHERE NOT fw"
)
def strand_rows(spark, sf_dir):
    """Strands that are searched: without forward, without reverse, and without forward where both mates lie on one strand."""
    rows = masked_reads(spark, sf_dir)
    kinds = {"nofw": filters.strands(rows, nofw=True), "norc": filters.strands(rows, norc=True), "ff": filters.strands(rows, nofw=True, policy="ff")}
    parts = [df.select("doc_id", "fw", F.lit(k).alias("kind")) for k, df in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


_TMO = (
    "WITH a AS (SELECT event_id, user_id % 20 AS chrom, event_id % 2000 AS s, event_id % 2000 + 20 AS e, event_id % 3 = 0 AS spliced FROM events), x AS (SELECT p_partkey % 20 AS chrom, p_partkey * 7 % 2000 AS l, p_partkey * 7 % 2000 + p_size AS r, p_partkey % 2000 + 5 AS kl FROM part) "
    "SELECT event_id FROM a WHERE spliced AND EXISTS (SELECT 1 FROM x WHERE x.chrom = a.chrom AND x.kl = a.s + 5) UNION ALL SELECT event_id FROM a WHERE NOT spliced AND EXISTS (SELECT 1 FROM x WHERE x.chrom = a.chrom AND x.l <= a.s AND a.e <= x.r)"
)


@query(_TMO)
def transcriptome_only(spark, sf_dir):
    """Alignments with known junctions only, or within an exon."""
    s = F.col("event_id") % 2000
    none = F.array().cast("array<struct<left:bigint,right:bigint>>")
    alns = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("chrom_id"), s.alias("start"), (s + 20).alias("end"), F.when(F.col("event_id") % 3 == 0, F.array(F.struct((s + 5).alias("left"), (s + 12).alias("right")))).otherwise(none).alias("junctions"))
    p = F.col("p_partkey")
    rows = t(spark, sf_dir, "part").select((p % 20).alias("chrom_id"), (p * 7 % 2000).alias("left"), (p * 7 % 2000 + F.col("p_size")).alias("right"), (p % 2000 + 5).alias("kl"))
    known = rows.select("chrom_id", F.col("kl").alias("left"), (F.col("kl") + 7).alias("right")).distinct()
    return filters.transcriptome_only(alns, rows.select("chrom_id", "left", "right"), known).select("event_id")


_ALTS = "v AS (SELECT p_partkey AS id, p_partkey % 9 AS chrom, p_size * 10 + p_partkey % 10 AS pos, CASE p_partkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'deletion' ELSE 'splice' END AS type, p_size % 5 + 1 AS len FROM part)"


def alts_of(spark, sf_dir) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return spread(t(spark, sf_dir, "part")).select(p.alias("id"), (p % 9).alias("chrom"), (size * 10 + p % 10).alias("pos"), F.when(p % 3 == 0, "single").when(p % 3 == 1, "deletion").otherwise("splice").alias("type"), (size % 5 + 1).alias("len"))


@query(
    f"WITH {_ALTS} SELECT a.chrom, a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.chrom = b.chrom AND (a.pos, a.id) < (b.pos, b.id) AND b.pos - a.pos <= 20 AND a.pos <> b.pos AND b.pos > a.pos + CASE a.type WHEN 'deletion' THEN a.len WHEN 'splice' THEN a.len + 2 ELSE 0 END"
)
def compatible_variants(spark, sf_dir):
    return filters.compatible_pairs(alts_of(spark, sf_dir), 20)


@query("WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS l, o_orderkey % 3 = 0 AS f, o_orderkey % 5 < 2 AS g FROM orders) SELECT o_orderkey, f = l AND g = l AS ff, f = (NOT l) AND g = (NOT l) AS rr, f = l AND g = (NOT l) AS fr, f = (NOT l) AND g = l AS rf FROM o")
def pair_orientation(spark, sf_dir):
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", *(filters.pair_orientation(p, k % 2 == 0, k % 3 == 0, k % 5 < 2).alias(p) for p in ("ff", "rr", "fr", "rf")))


# ---- scalar functions ---------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT n_nationkey, unnest(range(1, length(n_name) + 1)) AS p, n_name FROM nation), b AS (SELECT n_nationkey, p, substring(n_name, p, 1) AS b FROM l) SELECT n_nationkey, p, CASE b WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS code, "
    "CASE WHEN b IN ('A', 'C', 'G', 'T') THEN b ELSE 'N' END AS base, CASE b WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 WHEN 'R' THEN 5 WHEN 'Y' THEN 10 WHEN 'S' THEN 6 WHEN 'W' THEN 9 WHEN 'K' THEN 12 WHEN 'M' THEN 3 WHEN 'B' THEN 14 WHEN 'D' THEN 13 WHEN 'H' THEN 11 WHEN 'V' THEN 7 WHEN 'N' THEN 15 ELSE 0 END AS mask FROM b"
)
def base_codes(spark, sf_dir):
    rows = t(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.posexplode(F.filter(F.split("n_name", ""), lambda c: c != "")).alias("k", "b"))
    return rows.select("n_nationkey", (F.col("k") + 1).cast("long").alias("p"), seq.base_code("b").alias("code"), seq.code_base(seq.base_code("b")).alias("base"), seq.iupac_mask("b").alias("mask"))


@query(f"WITH {_SHORT} SELECT doc_id, CASE WHEN length(seq) - doc_id % 30 - doc_id % 50 > 0 THEN substring(seq, doc_id % 30 + 1, length(seq) - doc_id % 30 - doc_id % 50) ELSE '' END AS cut FROM short")
def trimmed_reads(spark, sf_dir):
    d = F.col("doc_id").cast("int")
    return short_reads(spark, sf_dir).select("doc_id", seq.trim("seq", d % 30, d % 50).alias("cut"))


_LETTERS = "substring('ACGTN', CAST(l_partkey % 5 AS INTEGER) + 1, 1) AS a, substring('ACGTN', CAST(l_suppkey % 5 AS INTEGER) + 1, 1) AS b"


@query(f"WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, {_LETTERS} FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN a = 'N' OR b = 'N' THEN -1 WHEN a = b THEN 0 ELSE -(2 + CAST(trunc(least(l_quantity, 40) / 40.0 * 4) AS INTEGER)) END AS score FROM l")
def base_scores(spark, sf_dir):
    letter = lambda c: F.substring(F.lit("ACGTN"), (F.col(c) % 5).cast("int") + 1, F.lit(1))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.base_score(letter("l_partkey"), letter("l_suppkey"), F.col("l_quantity")).alias("score"))


@query("SELECT l_orderkey, l_linenumber, 1 + CAST(trunc(least(l_quantity, 40) / 40.0) AS INTEGER) AS penalty FROM lineitem")
def clip_penalties(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.clip_penalty(F.chr(F.col("l_quantity").cast("int") + 33)).alias("penalty"))


@query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey AS intron, CAST(l_quantity AS BIGINT) AS anchor, l_discount AS p FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN anchor < 7 AND p < 0.05 THEN 2147483647 ELSE CAST(greatest(trunc(-8 + ln(intron)), 0) AS INTEGER) END AS canonical, "
    "CASE WHEN anchor < 14 THEN 2147483647 ELSE CAST(greatest(trunc(-8 + ln(intron)), 0) AS INTEGER) + 12 END AS noncanonical, CASE WHEN intron >= 65536 THEN 0.99 WHEN intron >= 32768 THEN 0.97 WHEN intron >= 16384 THEN 0.94 WHEN intron >= 8192 THEN 0.91 WHEN intron >= 4096 THEN 0.88 ELSE 0.8 END::DOUBLE AS need FROM l"
)
def splice_penalties(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    intron, anchor = F.col("l_partkey"), F.col("l_quantity").cast("long")
    # the rule is for probabilities under 0.1; half of them are halved here, so that both sides of it occur
    return l.select("l_orderkey", "l_linenumber", scoring.canonical_splice_penalty(intron, anchor, F.col("l_discount") * 2).alias("canonical"), scoring.noncanonical_splice_penalty(intron, anchor).alias("noncanonical"), scoring.required_probability(intron).alias("need"))


def _ratio_sql(window: str, shares: tuple) -> str:
    place = lambda k: "(CASE substring(" + window + f", {k + 1}, 1) " + " ".join(f"WHEN '{b}' THEN {row[k]!r}::DOUBLE / {g!r}::DOUBLE" for b, row, g in zip("ACGT", shares, scoring.GENOME, strict=True)) + " END)"
    return " * ".join(place(k) for k in range(len(shares[0])))


@query(
    f"WITH {REF}, w AS (SELECT item_id, p, substring(seq, p + 1, 9) AS donor, substring(seq, p + 20, 15) AS acceptor FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 33, 5)) AS p FROM ref WHERE length(seq) > 33)), r AS (SELECT item_id, p, {_ratio_sql('donor', scoring.DONOR)} * {_ratio_sql('acceptor', scoring.ACCEPTOR)} AS r FROM w) "
    "SELECT item_id, p, round(r / (r + 1), 6) AS probability FROM r"
)
def site_probabilities(spark, sf_dir):
    starts = F.when(F.length("seq") > 33, F.sequence(F.lit(0), F.length("seq") - 34, F.lit(5)))
    rows = ref_of(spark, sf_dir).select(F.col("chrom_id").alias("item_id"), "seq", F.explode(starts).alias("p"))
    window = lambda at, n: F.substring("seq", F.col("p") + at, F.lit(n))
    return rows.select("item_id", F.col("p").cast("long").alias("p"), F.round(scoring.site_probability(window(1, 9), window(20, 15)), 6).alias("probability"))


_EDITED = "WITH e AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 20 + 1 AS INTEGER) AS p, CAST(l_suppkey % 3 + 1 AS INTEGER) AS d, CAST(l_quantity AS INTEGER) % 3 + 1 AS i FROM lineitem) "


def edited_of(spark, sf_dir) -> DataFrame:
    """Reads of 50 bases A with a mismatch at p, d bases G lost before 30, and i bases put in at 40."""
    p, d, i = (F.col("l_partkey") % 20 + 1).cast("int"), (F.col("l_suppkey") % 3 + 1).cast("int"), F.col("l_quantity").cast("int") % 3 + 1
    edit = lambda pos, kind, ref, read, n: F.struct(pos.cast("int").alias("pos"), F.lit(kind).alias("type"), ref.alias("ref"), read.alias("read"), n.cast("int").alias("length"), F.lit(None).cast("string").alias("snp"))
    edits = F.array(edit(p, "mm", F.lit("C"), F.lit("A"), F.lit(1)), edit(F.lit(30), "del", F.repeat(F.lit("G"), d), F.lit(""), d), edit(F.lit(40), "ins", F.lit(""), F.repeat(F.lit("A"), i), i))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("A" * 50).alias("read"), edits.alias("edits"))


@query(
    _EDITED + "SELECT l_orderkey, l_linenumber, '30M' || d || 'D10M' || i || 'I' || (10 - i) || 'M' AS cigar, p || 'C' || (29 - p) || '^' || repeat('G', d) || (20 - i) AS md, repeat('A', p) || 'C' || repeat('A', 29 - p) || repeat('G', d) || repeat('A', 20 - i) AS ref, CAST(50 - i + d AS BIGINT) AS span FROM e"
)
def edit_strings(spark, sf_dir):
    """CIGAR, MD and reference side of edit lists, and the span that the CIGAR tells."""
    n, zero = F.length("read"), F.lit(0)
    rows = edited_of(spark, sf_dir).withColumn("cigar", cigar.cigar_of(n, "edits", zero, zero))
    return rows.select("l_orderkey", "l_linenumber", "cigar", cigar.md_of(n, "edits").alias("md"), cigar.reference_of("read", "edits").alias("ref"), cigar.reference_span(F.col("cigar")).alias("span"))


@query(_EDITED + "SELECT l_orderkey, l_linenumber, p AS mm, 30 AS del, p + 1 AS moved_ins, 49 - p AS mm_back, 20 AS del_back, 10 - i AS ins_back FROM e")
def moved_edits(spark, sf_dir):
    """Gaps slid left as far as the letters allow (the bases put in are A as all others: they come to the lost ones, which stay, as G is not A), and edits counted from the other end."""
    rows = edited_of(spark, sf_dir).select("l_orderkey", "l_linenumber", cigar.left_aligned("read", "edits").alias("l"), cigar.inverted(F.col("edits"), F.length("read")).alias("b"))
    at = lambda name, kind: F.element_at(F.filter(name, lambda e: e["type"] == kind), 1)["pos"]
    # the inserted bases stop at the edit before them, the deletion at 30
    return rows.select("l_orderkey", "l_linenumber", at("l", "mm").alias("mm"), at("l", "del").alias("del"), (at("l", "ins") - 30 + at("l", "mm") + 1).alias("moved_ins"), at("b", "mm").alias("mm_back"), at("b", "del").alias("del_back"), at("b", "ins").alias("ins_back"))


@query(
    "WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS fw, o_custkey % 3 AS mate, CASE o_orderkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS s FROM orders) SELECT o_orderkey, CASE WHEN s <> '.' THEN s END AS plain, "
    "CASE WHEN (mate = 2) <> fw THEN '+' ELSE '-' END AS f, CASE WHEN (mate = 2) = fw THEN '+' ELSE '-' END AS r FROM o"
)
def strand_tags(spark, sf_dir):
    k, mate = F.col("o_orderkey"), F.col("o_custkey") % 3
    site = F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise(".")
    return t(spark, sf_dir, "orders").select("o_orderkey", sam.strand_tag(site, k % 2 == 0, mate).alias("plain"), sam.strand_tag(site, k % 2 == 0, mate, "FR").alias("f"), sam.strand_tag(site, k % 2 == 0, mate, "RF").alias("r"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 > 0 THEN (l_partkey % 20 + 1) || '|S|a' || CASE WHEN l_linenumber % 4 = 1 THEN ',' || (28 - l_partkey % 20) || '|D|b,10|I|c' ELSE '' END END AS zs FROM lineitem")
def known_variant_tags(spark, sf_dir):
    """The three edits of edited_of as known variants a, b and c: all of them, the first, or none."""
    k = F.col("l_linenumber") % 4
    ids = F.when(k == 1, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(k > 0, F.array(F.lit("a"), F.lit(None), F.lit(None)))
    marked = F.zip_with("edits", ids, lambda e, i: e.withField("snp", i))
    return edited_of(spark, sf_dir).select("l_orderkey", "l_linenumber", sam.known_variant_tag(F.coalesce(marked, F.col("edits"))).alias("zs"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'UU' WHEN o_orderkey % 3 = 0 THEN 'CP' WHEN o_orderkey % 3 = 1 THEN 'DP' ELSE 'UP' END AS yt FROM orders")
def pair_tags(spark, sf_dir):
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", sam.pair_class_tag(F.col("o_custkey") % 2 == 1, k % 3 == 0, k % 3 == 1).alias("yt"))


def _number_sql(kmer: str, k: int) -> str:
    return " + ".join(f"CAST(instr('ACGT', substring({kmer}, {i + 1}, 1)) - 1 AS BIGINT) * {4 ** (k - 1 - i)}" for i in range(k))


def _hash_sql(x: str, bits: int) -> str:
    """The mix of functions.seq.minimizer_hash as nested SQL macros would be; x is a column."""
    half, mask = max(1, bits // 2), (1 << bits) - 1
    for odd in (0x2545F, 0x9E37B):
        y = f"xor({x}, {x} >> {half})"
        x = f"(((((({y}) >> {half}) * {odd}) & {(1 << (bits - half)) - 1}) << {half}) + (({y}) & {(1 << half) - 1}) * {odd}) & {mask}"
        x = f"({x})"
    return f"xor({x}, {x} >> {half})"


def _hashed(name: str, source: str, k: int) -> str:
    """CTE name(id, pos, kmer, h) of the k-mers of source (id, seq) with their hashes; each step of the mix is a column, so that it is taken once."""
    bits, half = 2 * k, k
    low, high, mask = (1 << half) - 1, (1 << (bits - half)) - 1, (1 << bits) - 1
    step = lambda x, odd: f"(((((({x}) >> {half}) * {odd}) & {high}) << {half}) + ((({x}) & {low}) * {odd})) & {mask}"
    return (
        f"{name}0 AS (SELECT id, p AS pos, length(seq) - {k} AS last, substring(seq, p + 1, {k}) AS kmer FROM (SELECT id, seq, unnest(range(0, length(seq) - {k - 1})) AS p FROM {source} WHERE length(seq) >= {k})), "
        f"{name}1 AS (SELECT *, {_number_sql('kmer', k)} AS x FROM {name}0), {name}2 AS (SELECT * EXCLUDE (x), xor(x, x >> {half}) AS x FROM {name}1), {name}3 AS (SELECT * EXCLUDE (x), {step('x', 0x2545F)} AS x FROM {name}2), "
        f"{name}4 AS (SELECT * EXCLUDE (x), xor(x, x >> {half}) AS x FROM {name}3), {name}5 AS (SELECT * EXCLUDE (x), {step('x', 0x9E37B)} AS x FROM {name}4), {name} AS (SELECT * EXCLUDE (x), xor(x, x >> {half}) AS h FROM {name}5)"
    )


def minimizers_sql(name: str, source: str, k: int, w: int) -> str:
    """CTE name(id, kmer, pos) of the minimizers of source (id, seq)."""
    return (
        f"{_hashed(name + '_g', source, k)}, {name}_w AS (SELECT a.id, a.pos AS at, b.kmer, b.pos, row_number() OVER (PARTITION BY a.id, a.pos ORDER BY b.h, b.pos DESC) AS k FROM {name}_g a JOIN {name}_g b ON a.id = b.id AND b.pos BETWEEN a.pos AND a.pos + {w - 1} WHERE a.pos <= greatest(a.last - {w - 1}, 0)), "
        f"{name} AS (SELECT DISTINCT id, kmer, pos FROM {name}_w WHERE k = 1)"
    )


@query(f"WITH {REF}, s AS (SELECT item_id AS id, seq FROM ref), {_hashed('g', 's', 15)} SELECT id AS item_id, pos, {_number_sql('kmer', 15)} AS number, h AS hash FROM g")
def kmer_hashes(spark, sf_dir):
    rows = seq.window_rows(ref_of(spark, sf_dir), ["chrom_id"], "seq", 15)
    return rows.select(F.col("chrom_id").alias("item_id"), "pos", seq.kmer_int("kmer").alias("number"), seq.minimizer_hash(seq.kmer_int("kmer"), 30).alias("hash"))


@query(f"WITH {REF}, s AS (SELECT item_id AS id, seq FROM ref), {minimizers_sql('m', 's', 15, 5)} SELECT id AS item_id, kmer, pos FROM m")
def minimizers(spark, sf_dir):
    return index.minimizers(ref_of(spark, sf_dir).withColumnRenamed("chrom_id", "id"), 15, 5).withColumnRenamed("id", "item_id")


@query(f"WITH {REF}, s AS (SELECT item_id AS id, seq FROM ref), {minimizers_sql('m', 's', 9, 5)} SELECT kmer, count(*) AS n FROM m GROUP BY kmer HAVING count(*) > 1")
def common_minimizers(spark, sf_dir):
    """Of 9 bases, so that some are common."""
    return index.minimizer_index(ref_of(spark, sf_dir).withColumnRenamed("chrom_id", "id"), 9, 5).where("n > 1").select("kmer", "n")


_DOC_PIECES = f"s AS (SELECT doc_id AS id, substring({_MAP}, 1, 400) AS seq FROM documents)"


def doc_pieces(spark, sf_dir) -> DataFrame:
    return reads_of(spark, sf_dir).select(F.col("doc_id").alias("id"), F.substring("seq", 1, 400).alias("seq"))


@query(f"WITH {_DOC_PIECES}, {minimizers_sql('m', 's', 31, 5)} SELECT kmer, count(*) AS n, count(DISTINCT id) AS docs FROM m GROUP BY kmer HAVING count(*) > 1")
def shared_minimizers(spark, sf_dir):
    """Minimizers of the first 400 bases of documents that occur more than once."""
    found = index.minimizer_index(doc_pieces(spark, sf_dir), 31, 5).where("n > 1")
    return found.select("kmer", "n", F.size(F.array_distinct(F.transform("places", lambda p: p["id"]))).cast("long").alias("docs"))


@query(
    f"WITH {_DOC_PIECES}, c AS (SELECT id, seq FROM s UNION ALL SELECT id + 1000000000, translate(reverse(seq), 'ACGT', 'TGCA') FROM s), {minimizers_sql('m', 'c', 31, 5)}, t AS (SELECT DISTINCT kmer FROM m WHERE id < 1000000000 AND id % 10 = 0) "
    "SELECT DISTINCT id % 1000000000 AS id FROM m JOIN t USING (kmer)"
)
def repeat_predicate(spark, sf_dir):
    """Documents with a minimizer, on either strand, of documents whose number ends in 0."""
    rows = doc_pieces(spark, sf_dir)
    return index.is_repeat(rows, index.minimizers(rows.where("id % 10 = 0"), 31, 5), 31, 5).select("id")


@query(
    f"WITH {_DOC_PIECES}, {minimizers_sql('m', 's', 31, 5)}, j AS (SELECT a.id, b.id AS target, b.pos - a.pos AS diagonal, a.pos FROM m a JOIN m b USING (kmer) WHERE a.id % 20 = 0) SELECT id, target, diagonal, count(*) AS hits, min(pos) AS start, max(pos) + 31 AS \"end\" FROM j GROUP BY ALL HAVING count(*) >= 3"
)
def minimizer_chains(spark, sf_dir):
    rows = doc_pieces(spark, sf_dir)
    return repeats.minimizer_hits(rows.where("id % 20 = 0"), rows, 31, 5, least=3)


@query("SELECT p_partkey, row_number() OVER (PARTITION BY chrom ORDER BY pos, k, CASE WHEN type = 'D' THEN CAST(data AS BIGINT) END NULLS FIRST, data, p_partkey) AS place FROM (SELECT p_partkey, p_partkey % 9 AS chrom, p_size AS pos, CASE p_partkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'S' ELSE 'D' END AS type, p_partkey % 3 AS k, CASE p_partkey % 3 WHEN 2 THEN CAST(p_partkey % 13 AS VARCHAR) ELSE substring('ACGT', CAST(p_partkey % 4 AS INTEGER) + 1, 1) END AS data FROM part)")
def variant_places(spark, sf_dir):
    p = F.col("p_partkey")
    rows = t(spark, sf_dir, "part").select(p, (p % 9).alias("chrom"), F.col("p_size").alias("pos"), F.when(p % 3 == 0, "I").when(p % 3 == 1, "S").otherwise("D").alias("type"), F.when(p % 3 == 2, (p % 13).cast("string")).otherwise(F.substring(F.lit("ACGT"), (p % 4).cast("int") + 1, F.lit(1))).alias("data"))
    w = Window.partitionBy("chrom").orderBy(*annotation.variant_order()[1:], "p_partkey")
    return rows.select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS bare, regexp_replace(split_part(p_name, ' ', 1) || '/' || (p_partkey % 3), '/[12]$', '') AS mate FROM part")
def clean_names(spark, sf_dir):
    first = F.split("p_name", " ")[0]
    return t(spark, sf_dir, "part").select("p_partkey", seq.clean_name("p_name").alias("bare"), seq.clean_name(F.concat(first, F.lit("/"), (F.col("p_partkey") % 3).cast("string"), F.lit(" x")), pair=True).alias("mate"))


@query(f"WITH {REF}, j AS (SELECT item_id, seq, unnest(range(0, length(seq) - 60, 3)) AS l FROM ref WHERE length(seq) > 60) SELECT item_id, l, (substring(seq, l + 2, 2) = 'GT' AND substring(seq, l + 38, 2) = 'AG') OR (substring(seq, l + 2, 2) = 'CT' AND substring(seq, l + 38, 2) = 'AC') AS canonical FROM j")
def canonical_junctions(spark, sf_dir):
    lefts = F.when(F.length("seq") > 60, F.sequence(F.lit(0), F.length("seq") - 61, F.lit(3)))
    rows = ref_of(spark, sf_dir).select(F.col("chrom_id").alias("item_id"), "seq", F.explode(lefts).alias("l"))
    return rows.select("item_id", F.col("l").cast("long").alias("l"), evaluate.is_canonical(F.col("seq"), F.col("l"), F.col("l") + 39).alias("canonical"))


@query(f"WITH {_SHORT} SELECT count(DISTINCT (seq, doc_id % 50)) AS reads, count(DISTINCT (seq, doc_id % 50)) AS seeds FROM short")
def read_seeds(spark, sf_dir):
    """As many seeds as different reads: a seed depends on the read alone."""
    name = (F.col("doc_id") % 50).cast("string")
    return short_reads(spark, sf_dir).agg(F.countDistinct("seq", name).alias("reads"), F.countDistinct(seq.read_seed(F.col("seq"), F.lit("I"), name, 3)).alias("seeds"))


@query("SELECT o_orderkey, (-(o_custkey % 30)) * 4294967296 + (o_orderkey % 2) * 268435456 + (o_orderkey % 3) * 16777216 + (255 - least(o_custkey * 100 // 100 % 300, 255)) * 65536 + 65535 - o_orderkey % 20 AS score FROM orders")
def composite_scores(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", scoring.composite_score(-(c % 30), k % 2, k % 3, c % 300 * 100, k % 20).alias("score"))


# ---- index, graph, joins ------------------------------------------------------------------------


@query(f"WITH {REF} SELECT item_id, p // 56 AS tile_id, p AS start, substring(seq, p + 1, 64) AS seq FROM (SELECT item_id, seq, unnest(range(0, greatest(length(seq) - 1, 0) + 1, 56)) AS p FROM ref)")
def reference_tiles(spark, sf_dir):
    return longs(index.tiles(ref_of(spark, sf_dir), 64, 8).withColumnRenamed("chrom_id", "item_id"), "tile_id", "start")


@query(f"WITH {REF}, g AS (SELECT item_id, p AS pos, substring(seq, p + 1, 8) AS kmer FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 7)) AS p FROM ref WHERE length(seq) >= 8)) SELECT kmer, count(*) AS n, string_agg(item_id || ':' || pos, ',' ORDER BY item_id, pos) AS places FROM g GROUP BY kmer")
def kmer_positions(spark, sf_dir):
    found = index.positions(index.kmer_index(ref_of(spark, sf_dir), 8))
    return found.select("kmer", "n", F.array_join(F.transform("positions", lambda p: F.concat_ws(":", p["chrom_id"].cast("string"), p["pos"].cast("string"))), ",").alias("places"))


_SINGLES = f"{REF}, sv AS (SELECT item_id, seq, p AS pos, translate(substring(seq, p + 1, 1), 'ACGT', 'CGTA') AS data FROM (SELECT item_id, seq, unnest(range(20, length(seq), 40)) AS p FROM ref WHERE length(seq) > 20))"


def singles_of(spark, sf_dir) -> DataFrame:
    """A changed base at every 40th place of benchmark."""
    starts = F.when(F.length("seq") > 20, F.sequence(F.lit(20), F.length("seq") - 1, F.lit(40)))
    rows = ref_of(spark, sf_dir).select("chrom_id", "seq", F.explode(starts).alias("pos")).withColumn("pos", F.col("pos").cast("long"))
    return rows.select("chrom_id", F.concat_ws("_", F.lit("s"), "chrom_id", "pos").alias("id"), F.lit("single").alias("type"), "pos", F.translate(F.substring("seq", F.col("pos").cast("int") + 1, F.lit(1)), "ACGT", "CGTA").alias("data"))


@query(f"WITH {_SINGLES}, w AS (SELECT item_id, seq, pos, data, unnest(range(greatest(pos - 11, 0), pos + 1)) AS s FROM sv) SELECT item_id, s AS pos, substring(seq, s + 1, pos - s) || data || substring(seq, pos + 2, s + 11 - pos) AS kmer, 's_' || item_id || '_' || pos AS alts FROM w WHERE s + 12 <= length(seq)")
def variant_kmers(spark, sf_dir):
    rows = index.variant_windows(ref_of(spark, sf_dir), singles_of(spark, sf_dir), 12)
    return rows.select(F.col("chrom_id").alias("item_id"), "pos", "kmer", F.array_join("alts", ",").alias("alts"))


@query(f"WITH {_SINGLES}, r AS (SELECT CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(greatest(length(seq) - 1, 0)) AS BIGINT) AS steps FROM ref), v AS (SELECT count(*) AS n, CAST(sum(1 + CASE WHEN pos + 1 < length(seq) THEN 1 ELSE 0 END) AS BIGINT) AS ends FROM sv) SELECT bases + n AS nodes, steps + ends AS edges FROM r, v")
def graph_size(spark, sf_dir):
    nodes, edges = index.graph(ref_of(spark, sf_dir), singles_of(spark, sf_dir))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))


@query(f"WITH {_SINGLES}, a AS (SELECT event_id, event_id % (SELECT count(*) FROM benchmark) AS item_id, event_id % 200 AS s, event_id % 200 + 30 AS e FROM events) SELECT event_id, 's_' || sv.item_id || '_' || pos AS v_id FROM a JOIN sv ON sv.item_id = a.item_id AND pos BETWEEN s - 5 AND e + 5")
def variants_near(spark, sf_dir):
    n = t(spark, sf_dir, "benchmark").count()
    k = F.col("event_id")
    alns = t(spark, sf_dir, "events").select("event_id", (k % n).alias("chrom_id"), (k % 200).alias("pos"), (k % 200 + 30).alias("end"))
    return variants.variant_windows_near(alns, singles_of(spark, sf_dir), 5).select("event_id", "v_id")


@query(f"WITH {_FITTING}, h AS (SELECT id, chrom, pos AS l, pos + 30 AS r FROM fit), q AS (SELECT event_id, 'b' || (event_id % 60) AS chrom, event_id % 390 AS s, event_id % 390 + 12 AS e FROM events) SELECT event_id, id AS hid FROM q JOIN h ON q.chrom = h.chrom AND l <= e AND s <= r")
def haplotypes_over(spark, sf_dir):
    haps = fitting_of(spark, sf_dir).select(F.col("id").alias("hid"), F.col("chrom").alias("chrom_id"), F.col("pos").alias("left"), (F.col("pos") + 30).alias("right"), F.array("id").alias("alts"))
    k = F.col("event_id")
    places = t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("b"), k % 60).alias("chrom_id"), (k % 390).alias("pos"), (k % 390 + 12).alias("end"))
    return variants.haplotypes_over(places, haps).select("event_id", "hid")


@query(
    f"WITH {REF}, a AS (SELECT item_id, seq, substring(seq, 61, 50) AS s FROM ref WHERE length(seq) >= 110), g AS (SELECT item_id, o, substring(s, o + 1, 12) AS kmer FROM (SELECT item_id, s, unnest(range(0, 39)) AS o FROM a)), i AS (SELECT item_id, p, substring(seq, p + 1, 12) AS kmer FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 11)) AS p FROM ref WHERE length(seq) >= 12)) "
    "SELECT item_id AS rdid, o AS rdoff, p AS pos FROM g JOIN i USING (item_id, kmer) WHERE p - o BETWEEN 0 AND 950"
)
def rescued_mates(spark, sf_dir):
    """Mates that lie 60 bases behind their anchored mates, on the reverse strand, found near them only."""
    ref = ref_of(spark, sf_dir)
    long = ref.where("length(seq) >= 110")
    anchors = long.select(F.col("chrom_id").alias("rdid"), F.lit(1).alias("mate"), "chrom_id", F.lit(0).cast("long").alias("pos"), F.lit(49).cast("long").alias("end"), F.lit(True).alias("fw"))
    one = long.select(F.col("chrom_id").alias("rdid"), F.lit(1).alias("mate"), F.substring("seq", 1, 50).alias("seq"))
    two = long.select(F.col("chrom_id").alias("rdid"), F.lit(2).alias("mate"), seq.reverse_complement(F.substring("seq", 61, 50)).alias("seq"))
    found = pairing.rescue(anchors, one.union(two), index.kmer_index(ref, 12), 12)
    return longs(found.where("mate = 2 and not fw").select("rdid", "rdoff", "pos"), "rdoff")


_MATES = (
    "al AS (SELECT l_orderkey AS rdid, l_linenumber % 2 + 1 AS mate, l_suppkey % 3 AS chrom, l_partkey * 40 AS pos, l_partkey * 40 + 99 AS e, l_linenumber % 3 = 0 AS fw, -(CAST(l_quantity AS BIGINT) % 20) AS score, l_linenumber AS k FROM lineitem), "
    "bs AS (SELECT rdid, max(score) FILTER (mate = 1) AS b1, max(score) FILTER (mate = 2) AS b2 FROM al GROUP BY rdid)"
)


def mates_of(spark, sf_dir) -> DataFrame:
    pos = F.col("l_partkey") * 40
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rdid"), (F.col("l_linenumber") % 2 + 1).alias("mate"), (F.col("l_suppkey") % 3).alias("chrom_id"), pos.alias("pos"), (pos + 99).alias("end"), (F.col("l_linenumber") % 3 == 0).alias("fw"), F.lit(100).alias("len"), (-(F.col("l_quantity").cast("long") % 20)).alias("score"), F.col("l_linenumber").cast("long").alias("k"))


@query(
    f"WITH {_MATES}, p AS (SELECT a.rdid, a.k AS ka, b.k AS kb, a.score + b.score AS score, a.pos AS p1, b.pos AS p2, a.e AS e1, b.e AS e2, a.fw FROM al a JOIN al b ON a.rdid = b.rdid AND a.chrom = b.chrom AND a.mate = 1 AND b.mate = 2 AND a.fw <> b.fw), "
    "o AS (SELECT * FROM p WHERE CASE WHEN fw THEN p1 <= p2 AND e1 <= e2 ELSE p2 <= p1 AND e2 <= e1 END AND greatest(p1, p2) - least(e1, e2) <= 500000), m AS (SELECT *, max(score) OVER (PARTITION BY rdid) AS best FROM o) "
    "SELECT rdid, ka, kb, score FROM m JOIN bs USING (rdid) WHERE score >= best AND score >= b1 + b2 - 36"
)
def paired_alignments(spark, sf_dir):
    return pairing.concordant_pairs(mates_of(spark, sf_dir)).select("rdid", F.col("a.k").alias("ka"), F.col("b.k").alias("kb"), "score")


_REPEATS = "c AS (SELECT n_nationkey AS rep, n_regionkey AS chrom_id, n_nationkey * 1000 AS base, n_nationkey % 2 = 0 AS fw FROM nation), h AS (SELECT event_id, user_id % 25 AS rep, event_id % 380 AS p FROM events), x AS (SELECT event_id, chrom_id, CASE WHEN fw THEN base + p ELSE base + 380 - p END AS pos FROM h JOIN c USING (rep))"


def repeat_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    hits = t(spark, sf_dir, "events").select(F.col("event_id").alias("rdid"), (F.col("user_id") % 25).alias("rep_id"), (F.col("event_id") % 380).alias("pos"), F.lit(20).alias("len"))
    n = F.col("n_nationkey").cast("long")
    reps = t(spark, sf_dir, "nation").groupBy(n.alias("rep_id")).agg(F.collect_list(F.struct(F.col("n_regionkey").cast("long").alias("chrom_id"), (n * 1000).alias("pos"), (n % 2 == 0).alias("fw"))).alias("positions")).withColumn("consensus", F.repeat(F.lit("A"), F.lit(400)))
    return hits, reps


@query(f"WITH {_REPEATS}, a AS (SELECT event_id, event_id % 5 AS chrom_id, event_id * 17 % 25000 AS spot FROM events) SELECT x.event_id, CAST(x.chrom_id AS BIGINT) AS chrom_id, CAST(pos AS BIGINT) AS pos FROM x JOIN a USING (event_id, chrom_id) WHERE abs(pos - spot) <= 1000")
def repeats_near_anchors(spark, sf_dir):
    hits, reps = repeat_tables(spark, sf_dir)
    k = F.col("event_id")
    anchors = t(spark, sf_dir, "events").select(k.alias("rdid"), (k % 5).alias("chrom_id"), (k * 17 % 25000).alias("pos"))
    return repeats.expand_near(hits, reps, anchors, 1000).select(F.col("rdid").alias("event_id"), "chrom_id", "pos")


@query(f"WITH {_REPEATS}, y AS (SELECT event_id, chrom_id, pos + event_id % 900 - 450 AS pos FROM x) SELECT x.event_id, CAST(x.chrom_id AS BIGINT) AS chrom_id, CAST(x.pos AS BIGINT) AS pos1, CAST(y.pos AS BIGINT) AS pos2 FROM x JOIN y ON x.event_id = y.event_id AND x.chrom_id = y.chrom_id AND abs(x.pos - y.pos) <= 300")
def common_repeat_places(spark, sf_dir):
    hits, reps = repeat_tables(spark, sf_dir)
    one = repeats.expand(hits, reps).select("rdid", "chrom_id", "pos")
    two = one.withColumn("pos", F.col("pos") + F.col("rdid") % 900 - 450)
    return repeats.common_places(one, two, 300).withColumnRenamed("rdid", "event_id")


# ---- kernels ------------------------------------------------------------------------------------

_NAMES = f"p AS (SELECT p_partkey, p_brand, {_MAP.replace('text', 'p_name')} AS s FROM part)"


@query(f"WITH {_NAMES} SELECT a.p_partkey AS a, b.p_partkey AS b, -CAST(levenshtein(a.s, b.s) AS INTEGER) AS score FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_partkey % 7 = 0")
def dp_edit_distance(spark, sf_dir):
    """The affine kernel with unit costs and fixed ends is the edit distance."""
    unit = replace(Scoring(), mismatch_max=1, mismatch_min=1, read_gap_open=0, read_gap_extend=1, ref_gap_open=0, ref_gap_extend=1)
    p = spread(t(spark, sf_dir, "part")).select("p_partkey", "p_brand", seq.text_to_bases("p_name").alias("s"))
    asked = p.where("p_partkey % 7 = 0")
    # many parts share a name: each two different texts of a brand are aligned once
    texts = asked.select("p_brand", F.col("s").alias("read")).distinct().join(p.select("p_brand", F.col("s").alias("window")).distinct(), "p_brand").select("read", "window").distinct()
    told = written(kernels.align_candidates(texts.select("read", F.lit(None).cast("string").alias("qual"), "window"), unit, fixed_ends=True).select("read", "window", "score"), "distances")
    one = asked.select(F.col("p_partkey").alias("a"), "p_brand", "s").join(told, F.col("s").eqNullSafe(F.col("read"))).select("a", "p_brand", "window", "score").alias("one")
    two = p.select(F.col("p_partkey").alias("b"), "p_brand", "s").alias("two")
    return one.join(two, (F.col("one.p_brand") == F.col("two.p_brand")) & F.col("window").eqNullSafe(F.col("two.s")) & (F.col("a") < F.col("b"))).select("a", "b", "score")


@query(
    f"{BASE}, d AS (SELECT DISTINCT doc_id, item_id, pos - rdoff AS diagonal FROM hits), w AS (SELECT d.*, substring(reads.seq, greatest(-diagonal, 0) + 1, 100) AS a, substring(ref.seq, greatest(diagonal, 0) + 1, 100) AS b FROM d JOIN reads USING (doc_id) JOIN ref USING (item_id)), n AS (SELECT *, least(length(a), length(b)) AS n FROM w) "
    "SELECT doc_id, item_id, CAST(diagonal AS BIGINT) AS diagonal, -6 * CAST(len(list_filter(range(1, n + 1), lambda i: substring(a, i, 1) <> substring(b, i, 1))) AS BIGINT) AS score FROM n"
)
def ungapped_scores(spark, sf_dir):
    """Up to 100 bases of each diagonal of a seed, from where both sequences have begun."""
    d = hits_of(spark, sf_dir).select(F.col("rdid").alias("doc_id"), "chrom_id", (F.col("pos") - F.col("rdoff")).alias("diagonal")).distinct()
    j = d.join(reads_of(spark, sf_dir).withColumnRenamed("seq", "s"), "doc_id").join(ref_of(spark, sf_dir).withColumnRenamed("seq", "r"), "chrom_id")
    cut = lambda c, start: F.substring(c, F.greatest(start, F.lit(0)).cast("int") + 1, F.lit(100))
    both = j.select("doc_id", F.col("chrom_id").alias("item_id"), "diagonal", cut("s", -F.col("diagonal")).alias("a"), cut("r", F.col("diagonal")).alias("b"))
    n = F.least(F.length("a"), F.length("b"))
    return both.select("doc_id", "item_id", "diagonal", scoring.ungapped_score(F.substring("a", F.lit(1), n), F.substring("b", F.lit(1), n)).alias("score"))


# ---- ranking ------------------------------------------------------------------------------------


@query("SELECT DISTINCT l_suppkey AS rdid, l_partkey % 5 AS chrom_id, l_partkey % 40 AS pos, l_linenumber % 2 = 0 AS fw FROM lineitem")
def distinct_alignments(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rdid"), (F.col("l_partkey") % 5).alias("chrom_id"), (F.col("l_partkey") % 40).alias("pos"), (F.col("l_linenumber") % 2 == 0).alias("fw"), F.lit("10M").alias("cigar"), F.lit("10").alias("md"), "l_orderkey")
    return ranking.distinct_alignments(rows, ["rdid"]).select("rdid", "chrom_id", "pos", "fw")


@query(
    "WITH a AS (SELECT l_orderkey AS rdid, l_linenumber AS k, l_partkey % 4 AS d, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + 8 AS e, l_suppkey AS score FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY rdid ORDER BY score DESC, k, d, s) AS n FROM a) "
    "SELECT rdid, CAST(k AS BIGINT) AS k FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.rdid = r.rdid AND b.d = r.d AND b.n < r.n AND b.s < r.e AND r.s < b.e)"
)
def distinct_cells(spark, sf_dir):
    s = F.col("l_quantity").cast("long")
    block = F.struct(s.alias("read_off"), (s + F.col("l_partkey") % 4).alias("ref_off"), F.lit(8).cast("long").alias("len"))
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rdid"), F.col("l_linenumber").cast("long").alias("k"), F.lit(0).alias("chrom_id"), F.lit(True).alias("fw"), F.col("l_suppkey").alias("score"), F.array(block).alias("blocks"))
    return ranking.distinct_cells(rows, ["rdid"], [F.desc("score"), F.col("k"), F.col("blocks")]).select("rdid", "k")


@query("SELECT l_orderkey AS rdid, least(count(*), 3) AS n FROM lineitem GROUP BY l_orderkey")
def random_choice(spark, sf_dir):
    """How many alignments of each read are left of three at most."""
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rdid"), F.col("l_linenumber").alias("chrom_id"), F.col("l_partkey").alias("pos"))
    return ranking.random_k(rows, ["rdid"], 3, 5).groupBy("rdid").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT l_orderkey AS rdid, l_linenumber % 2 + 1 AS mate, l_partkey AS pos, count(*) FILTER (l_linenumber % 2 = 0) OVER (PARTITION BY l_orderkey) AS n1, count(*) FILTER (l_linenumber % 2 = 1) OVER (PARTITION BY l_orderkey) AS n2 FROM lineitem) SELECT rdid, max(pos) FILTER (mate = 1) AS a, max(pos) FILTER (mate = 2) AS b FROM m WHERE n1 = 1 AND n2 = 1 GROUP BY rdid")
def discordant_mates(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rdid"), (F.col("l_linenumber") % 2 + 1).alias("mate"), F.col("l_partkey").alias("pos"))
    n = lambda m: F.count_if(F.col("mate") == m).over(Window.partitionBy("rdid"))
    told = rows.withColumn("n1", n(1)).withColumn("n2", n(2)).withColumn("category", ranking.category(F.lit(0), F.col("n1"), F.col("n2"))).drop("n1", "n2")
    return ranking.discordant_pairs(told).select("rdid", F.col("a.pos").alias("a"), F.col("b.pos").alias("b"))


def _tenth(x: str) -> str:
    return f"CAST(least(greatest(trunc(({x}) * (10.0::DOUBLE / 30.0::DOUBLE) + 0.5::DOUBLE), 0), 10) AS INTEGER)"


@query(
    "WITH o AS (SELECT o_orderkey, -(o_custkey % 31) AS best, CASE WHEN o_orderkey % 3 > 0 THEN -(o_custkey % 31) - o_orderkey % 12 END AS second, o_orderkey % 5 = 0 AS paired, o_orderkey % 2 = 0 AS done FROM orders) "
    f"SELECT o_orderkey, CASE WHEN paired THEN 44 WHEN second IS NULL THEN CASE WHEN NOT done THEN 255 WHEN best = 0 THEN 44 ELSE {list(ranking.BINNED_ALONE)}[{_tenth('-best')} + 1] END WHEN best = 0 THEN {list(ranking.BINNED_PERFECT)}[1] ELSE {[list(r) for r in ranking.BINNED]}[{_tenth('best - second')} + 1][{_tenth('-best')} + 1] END AS mapq FROM o"
)
def mapq_binned(spark, sf_dir):
    k, best = F.col("o_orderkey"), -(F.col("o_custkey") % 31)
    second = F.when(k % 3 > 0, best - k % 12)
    return t(spark, sf_dir, "orders").select("o_orderkey", ranking.mapq_binned(best, second, F.lit(0), F.lit(-30), k % 5 == 0, k % 2 == 0).alias("mapq"))


@query("WITH s AS (SELECT l_orderkey AS rdid, CAST(l_linenumber AS BIGINT) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_suppkey, l_partkey, l_linenumber % 2 = 0, l_linenumber) AS n FROM lineitem) SELECT rdid, k FROM s WHERE n <= 3")
def longest_seeds(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rdid"), F.col("l_linenumber").cast("long").alias("k"), F.col("l_quantity").alias("len"), F.col("l_suppkey").alias("chrom_id"), F.col("l_partkey").alias("pos"), (F.col("l_linenumber") % 2 == 0).alias("fw"))
    return ranking.seed_cap(rows, ["rdid"], 3).select("rdid", "k")


@query("WITH h AS (SELECT l_suppkey AS rdid, l_partkey % 6 AS rep_id, -(CAST(l_quantity AS BIGINT) % 25) AS score, l_orderkey * 10 + l_linenumber AS pos FROM lineitem), b AS (SELECT *, max(score) OVER (PARTITION BY rdid) AS best FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY rdid, rep_id ORDER BY score DESC, pos) AS n FROM b WHERE score >= best - 6) SELECT rdid, rep_id, score, pos FROM n WHERE n = 1")
def repeat_hits_kept(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rdid"), (F.col("l_partkey") % 6).alias("rep_id"), (-(F.col("l_quantity").cast("long") % 25)).alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return ranking.repeat_choice(rows, ["rdid"], 6)


# ---- metrics and evaluation ---------------------------------------------------------------------


@query("SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem")
def counter_statistics(spark, sf_dir):
    return metrics.running(t(spark, sf_dir, "lineitem"), "l_quantity").select("n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("WITH e AS (SELECT l_orderkey AS transcript_id, l_orderkey % 50 AS chrom, l_suppkey AS l, l_suppkey + CAST(l_quantity AS INTEGER) AS r FROM lineitem) SELECT transcript_id, transcript_id % 500 AS gene_id, chrom, count(*) AS exons, min(l) AS \"left\", CAST(sum(r - l + 1) AS BIGINT) AS len FROM e GROUP BY transcript_id, chrom")
def transcript_rows(spark, sf_dir):
    left = F.col("l_suppkey")
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("transcript_id"), (F.col("l_orderkey") % 500).alias("gene_id"), (F.col("l_orderkey") % 50).alias("chrom"), F.lit("+").alias("strand"), left.alias("left"), (left + F.col("l_quantity").cast("int")).alias("right"))
    size = F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + e["right"] - e["left"] + 1)
    return metrics.transcripts(rows).select("transcript_id", "gene_id", "chrom", F.size("exons").cast("long").alias("exons"), F.col("exons")[0]["left"].alias("left"), size.alias("len"))


_COST = "t AS (SELECT o_orderkey AS name, o_custkey % 5 AS chrom, o_orderkey AS pos, '50M' AS cigar FROM orders), f AS (SELECT l_orderkey AS name, (SELECT 0) + l_suppkey % 5 AS chrom, l_orderkey + l_linenumber % 2 AS pos, CASE WHEN l_linenumber % 3 = 0 THEN '49M1S' ELSE '50M' END AS cigar, l_partkey % 6 AS nm FROM lineitem WHERE l_orderkey % 4 > 0)"
_COST += ", p AS (SELECT t.name, count(f.name) AS n, count(*) FILTER (f.chrom = t.chrom AND f.pos = t.pos) AS c, count(*) FILTER (f.chrom = t.chrom AND f.pos = t.pos AND f.cigar = t.cigar) AS x, min(nm) AS nm FROM t LEFT JOIN f ON f.name = t.name GROUP BY t.name)"


@query(
    f"WITH {_COST} SELECT count(*) AS total, count(*) FILTER (n > 0) AS mapped, count(*) FILTER (n = 1) AS \"unique\", count(*) FILTER (n = 0) AS unmapped, count(*) FILTER (c > 0) AS correct, count(*) FILTER (x > 0) AS exact, count(*) FILTER (n = 1 AND c > 0) AS unique_correct, "
    "count(*) FILTER (nm = 0) AS nm_0, count(*) FILTER (nm = 1) AS nm_1, count(*) FILTER (nm = 2) AS nm_2, count(*) FILTER (nm = 3) AS nm_3, count(*) FILTER (nm > 3) AS nm_more FROM p"
)
def mapping_cost(spark, sf_dir):
    truth = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.lit(0).alias("mate"), (F.col("o_custkey") % 5).alias("chrom"), F.col("o_orderkey").alias("pos"), F.lit("50M").alias("cigar"))
    found = t(spark, sf_dir, "lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("name"), F.lit(0).alias("mate"), (F.col("l_suppkey") % 5).alias("chrom"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("pos"), F.when(F.col("l_linenumber") % 3 == 0, "49M1S").otherwise("50M").alias("cigar"), (F.col("l_partkey") % 6).alias("nm"))
    return evaluate.mapping_cost(found, truth)


@query(
    "WITH f AS (SELECT l_orderkey AS name, l_suppkey % 5 AS chrom, l_orderkey AS p1, l_orderkey + l_partkey AS p2 FROM lineitem WHERE l_orderkey % 4 > 0), p AS (SELECT o_orderkey AS name, count(f.name) AS n, count(*) FILTER (f.chrom = o_custkey % 5 AND p1 = o_orderkey AND p2 = o_orderkey + o_custkey) AS c, count(*) FILTER (abs(p1 - p2) <= 1000) AS k FROM orders LEFT JOIN f ON f.name = o_orderkey GROUP BY o_orderkey) "
    "SELECT count(*) AS total, count(*) FILTER (n > 0) AS mapped, count(*) FILTER (n = 1) AS \"unique\", count(*) FILTER (n = 0) AS unmapped, count(*) FILTER (c > 0) AS correct, count(*) FILTER (k > 0) AS concordant FROM p"
)
def pair_mapping_cost(spark, sf_dir):
    k = F.col("o_orderkey")
    truth = t(spark, sf_dir, "orders").select(k.alias("name"), (F.col("o_custkey") % 5).alias("chrom"), k.alias("pos1"), (k + F.col("o_custkey")).alias("pos2"))
    found = t(spark, sf_dir, "lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("name"), (F.col("l_suppkey") % 5).alias("chrom"), F.col("l_orderkey").alias("pos1"), (F.col("l_orderkey") + F.col("l_partkey")).alias("pos2"))
    return evaluate.pair_cost(found, truth)


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_custkey % 2 = 1 AND o_custkey - o_orderkey % 7 - o_orderkey % 900 + 1 <= 1000 AS ok FROM orders")
def concordance(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", metrics.is_concordant(F.lit(1), k % 2 == 0, k % 900, F.when(k % 3 == 0, 1).otherwise(2), c % 2 == 0, c, k % 7).alias("ok"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    """Counts of a stream in windows of an hour, here over a batch."""
    from ..streaming.feedback import windowed_counts

    rows = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(rows, "ts", "1 hour", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# ---- variants and repeats -----------------------------------------------------------------------


@query("WITH v AS (SELECT p_partkey AS id, p_size % 10 AS pos, CASE p_partkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'deletion' ELSE 'insertion' END AS type, p_partkey % 4 AS len, p_brand AS alt FROM part) SELECT id, row_number() OVER (ORDER BY pos, CASE type WHEN 'insertion' THEN 0 WHEN 'single' THEN 1 ELSE 2 END, len, alt, id) AS place FROM v")
def alt_places(spark, sf_dir):
    """Places in the order of an index's variants, counted over buckets of the first key."""
    p = F.col("p_partkey")
    rows = t(spark, sf_dir, "part").select(p.alias("id"), (F.col("p_size") % 10).alias("pos"), F.when(p % 3 == 0, "single").when(p % 3 == 1, "deletion").otherwise("insertion").alias("type"), (p % 4).alias("len"), F.col("p_brand").alias("alt_seq"))
    w = Window.partitionBy("pos").orderBy(*annotation.alt_order()[1:], "id")
    before = rows.groupBy("pos").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before), "pos").select("id", (F.row_number().over(w) + F.col("before")).alias("place"))


@query(
    "WITH v AS (SELECT p_partkey AS id, p_size AS pos, CASE p_partkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'deletion' ELSE 'insertion' END AS type, p_partkey % 4 AS len, p_partkey % 2 = 0 AS fw FROM part), w AS (SELECT *, CASE WHEN type = 'deletion' AND NOT fw THEN pos - len + 1 WHEN type = 'insertion' AND NOT fw THEN pos + 1 ELSE pos END AS spot FROM v) "
    "SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.type = b.type AND a.spot = b.spot AND a.len = b.len AND a.id < b.id AND a.id % 10 = 0"
)
def equal_variants(spark, sf_dir):
    p = F.col("p_partkey")
    rows = t(spark, sf_dir, "part").select(p.alias("id"), F.col("p_size").cast("long").alias("pos"), F.when(p % 3 == 0, "single").when(p % 3 == 1, "deletion").otherwise("insertion").alias("type"), (p % 4).alias("len"), F.lit("A").alias("alt_seq"), (p % 2 == 0).alias("fw"))
    a, b = rows.where("id % 10 = 0").alias("a"), rows.alias("b")
    return a.join(b, annotation.same_variant("a", "b", F.col("a.fw"), F.col("b.fw")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


_RANGES = "r AS (SELECT p_partkey AS id, p_partkey % 40 AS chrom_id, p_partkey * 13 % 3000 AS s, p_partkey * 13 % 3000 + p_size * 3 AS e FROM part)"


def ranges_of(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    return t(spark, sf_dir, "part").select(p.alias("id"), (p % 40).alias("chrom_id"), (p * 13 % 3000).alias("start"), (p * 13 % 3000 + F.col("p_size") * 3).alias("end"))


@query(f"WITH {_RANGES} SELECT a.chrom_id, a.id AS a, b.id AS b, CASE WHEN a.s <= b.s AND b.e <= a.e THEN 'contains' WHEN b.s <= a.s AND a.e <= b.e THEN 'inside' ELSE 'overlap' END AS kind FROM r a JOIN r b ON a.chrom_id = b.chrom_id AND a.id < b.id AND a.s <= b.e AND b.s <= a.e")
def repeat_overlaps(spark, sf_dir):
    return repeats.overlaps(ranges_of(spark, sf_dir))


@query(f"WITH {_RANGES} SELECT id FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE a.chrom_id = b.chrom_id AND a.id <> b.id AND b.s <= a.s AND a.e <= b.e AND (a.s <> b.s OR a.e <> b.e OR b.id < a.id))")
def redundant_ranges(spark, sf_dir):
    return repeats.redundant(ranges_of(spark, sf_dir))


@query("WITH c AS (SELECT l_suppkey AS chrom_id, l_partkey % 50 AS pos, l_orderkey AS rep_id, CAST(l_quantity AS BIGINT) AS ext FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY chrom_id, pos ORDER BY ext DESC, rep_id) AS n FROM c) SELECT chrom_id, pos, rep_id, ext FROM n WHERE n = 1 AND ext * 2 + 50 >= 100")
def reassigned_seeds(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chrom_id"), (F.col("l_partkey") % 50).alias("pos"), F.col("l_orderkey").alias("rep_id"), F.col("l_quantity").cast("long").alias("ext"))
    return repeats.reassign_seeds(rows).distinct()


_COPIES = f"c AS (SELECT doc_id % 40 AS rep, doc_id AS allele, substring({_MAP}, 1, 30) AS s FROM documents), k AS (SELECT rep, min(s) AS cons FROM c WHERE length(s) = 30 GROUP BY rep)"


def copies_of(spark, sf_dir) -> DataFrame:
    c = reads_of(spark, sf_dir).select((F.col("doc_id") % 40).alias("rep_id"), F.col("doc_id").alias("allele"), F.substring("seq", 1, 30).alias("seq")).where("length(seq) = 30")
    return c.join(c.groupBy("rep_id").agg(F.min("seq").alias("consensus")), "rep_id")


@query(f"WITH {_COPIES} SELECT rep AS rep_id, allele, p - 1 AS pos, substring(cons, p, 1) AS ref, substring(s, p, 1) AS alt FROM (SELECT rep, allele, s, cons, unnest(range(1, 31)) AS p FROM c JOIN k USING (rep) WHERE length(s) = 30) WHERE substring(cons, p, 1) <> substring(s, p, 1)")
def copy_variants(spark, sf_dir):
    return longs(repeats.copy_variants(copies_of(spark, sf_dir)), "pos")


@query(f"WITH {_COPIES} SELECT rep AS rep_id, count(DISTINCT s) AS kinds, count(*) AS copies FROM c JOIN k USING (rep) WHERE length(s) = 30 AND s <> cons GROUP BY rep")
def copy_haplotypes(spark, sf_dir):
    """How many different sets of variants the copies of a repeat show, and how many copies show some."""
    sets = repeats.allele_haplotypes(repeats.copy_variants(copies_of(spark, sf_dir)))
    return sets.groupBy("rep_id").agg(F.count("*").alias("kinds"), F.sum(F.size("alleles")).alias("copies"))


@query("SELECT n_regionkey AS rep_id FROM nation GROUP BY n_regionkey HAVING count(*) >= 5 AND min(n_nationkey) * 60 + 60 >= 100")
def satisfied_repeats(spark, sf_dir):
    reps = t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("rep_id")).agg(F.collect_list("n_nationkey").alias("positions"), F.repeat(F.lit("A"), (F.min("n_nationkey") * 60 + 60).cast("int")).alias("consensus"))
    return repeats.satisfies(reps).select("rep_id")


@query(f"WITH {REF} SELECT item_id, replace(seq, 'CG', 'TG') AS seq FROM ref")
def collapsed_reference(spark, sf_dir):
    return ref_of(spark, sf_dir).select(F.col("chrom_id").alias("item_id"), seq.collapse_cg("seq").alias("seq"))


_SEEDS = (
    f"{REF}, w AS (SELECT item_id, p AS pos, substring(seq, p + 1, 6) AS f FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 5)) AS p FROM ref WHERE length(seq) >= 6)), b AS (SELECT f AS seed, true AS fw FROM w UNION ALL SELECT translate(reverse(f), 'ACGT', 'TGCA'), false FROM w), "
    "n AS (SELECT seed, count(*) AS n, count(*) FILTER (fw) AS nf FROM b GROUP BY seed)"
)


@query(f"WITH {_SEEDS} SELECT seed, n FROM n WHERE n >= 5 AND (nf * 2 > n OR (nf * 2 = n AND seed <= translate(reverse(seed), 'ACGT', 'TGCA')))")
def repeated_seeds(spark, sf_dir):
    return repeats.repeated_seeds(ref_of(spark, sf_dir), RepeatOptions(seed_length=6, seed_count=5)).select("seed", "n")


@query(f"WITH {REF}, r AS (SELECT item_id, seq, substring(seq, 11, 40) AS cons FROM ref WHERE length(seq) >= 60), p AS (SELECT item_id, cons, unnest([10, 12]) AS pos, seq FROM r) SELECT item_id, CAST(pos AS BIGINT) AS pos, CAST(len(list_filter(range(1, 41), lambda i: substring(cons, i, 1) <> substring(seq, pos + i, 1))) AS INTEGER) AS mismatches FROM p")
def repeat_mismatches(spark, sf_dir):
    """A copy at its own place, and one taken two bases too far."""
    ref = ref_of(spark, sf_dir).where("length(seq) >= 60")
    place = lambda p: F.struct(F.col("chrom_id"), F.lit(p).cast("long").alias("pos"), F.lit(True).alias("fw"))
    reps = ref.select(F.col("chrom_id").alias("rep_id"), F.substring("seq", 11, 40).alias("consensus"), F.array(place(10), place(12)).alias("positions"))
    return repeats.validate(reps, ref).select(F.col("rep_id").alias("item_id"), "pos", "mismatches")


# ---- simulation, embedding ----------------------------------------------------------------------


@query(f"WITH {REF} SELECT item_id, round(length(seq) / (SELECT sum(length(seq)) FROM ref), 9) AS share FROM ref")
def dna_profile(spark, sf_dir):
    return simulate.dna_profile(ref_of(spark, sf_dir)).select(F.col("chrom_id").alias("item_id"), F.round("share", 9).alias("share"))


@query(f"WITH {REF} SELECT item_id, CAST(2 * 20 AS BIGINT) AS reads, CAST(2 * 20 AS BIGINT) AS ok, CAST(20 AS BIGINT) AS reverse FROM ref WHERE length(seq) >= 120")
def simulated_reads(spark, sf_dir):
    """Twenty pairs of each sequence over 120 bases, with variants and errors: each record spells the reference by its CIGAR and MD."""
    ref = ref_of(spark, sf_dir).where("length(seq) >= 120").withColumn("chrom", F.concat(F.lit("b"), "chrom_id"))
    snps = singles_of(spark, sf_dir).groupBy("chrom_id").agg(F.collect_list(F.struct("id", "type", "pos", "data")).alias("variants"))
    block = F.array(F.struct(F.lit(0).alias("start"), F.length("seq").alias("end")))
    made = ref.join(snps, "chrom_id", "left").select(F.col("chrom_id").cast("string").alias("transcript"), "chrom", F.col("seq").alias("bases"), F.lit(0).alias("offset"), block.alias("blocks"), "variants", F.lit(1.0).alias("share"))
    told = simulate.validate(written(simulate.simulate(made, 20, read_length=40, fragment=100, error_rate=0.02, seed=4), "simulated"), ref)
    return told.groupBy(F.substring("chrom", 2, 99).cast("long").alias("item_id")).agg(F.count("*").alias("reads"), F.count_if("ok").alias("ok"), F.count_if(~F.col("fw")).alias("reverse"))


@query("SELECT n_nationkey AS chrom_id, n_name AS chrom FROM nation")
def session_names(spark, sf_dir):
    with_index = open_index(spark, sf_dir)
    return with_index.reference_names()


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey IN (0, 24) UNION ALL SELECT 25, NULL")
def session_name_by_id(spark, sf_dir):
    opened = open_index(spark, sf_dir)
    names = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(opened.reference_name(k)).cast("string").alias("name")) for k in (0, 24, 25)))
    return spark.range(1).select(F.explode(names).alias("x")).select("x.*")


@query("SELECT CAST(n_regionkey AS BIGINT) AS chrom_id, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1000 + 7 ELSE n_nationkey * 1000 + 373 END AS BIGINT) AS pos, n_nationkey % 2 = 0 AS fw FROM nation WHERE n_regionkey = 2")
def session_repeat_expand(spark, sf_dir):
    return open_index(spark, sf_dir).repeat_expand(2, 7, 20)


@query("SELECT CAST(n_regionkey AS BIGINT) AS chrom_id, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1000 + 7 ELSE n_nationkey * 1000 + 373 END AS BIGINT) AS pos, n_nationkey % 2 = 0 AS fw FROM nation")
def repeat_expand_function(spark, sf_dir):
    """The same as a table function in SQL, for every repeat."""
    register(spark)
    open_index(spark, sf_dir).tables["repeats"].createOrReplaceTempView("seqloom_repeats")
    return spark.sql("SELECT f.chrom_id, f.pos, f.fw FROM seqloom_repeats r, LATERAL repeat_expand(length(r.consensus), r.positions, 7, 20) f")


def open_index(spark, sf_dir) -> Index:
    """An index with the nations as references, and one repeat for each region."""
    ref = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chrom_id"), F.col("n_name").alias("chrom"), F.repeat(F.lit("ACGT"), F.lit(10)).alias("seq"))
    n = F.col("n_nationkey").cast("long")
    place = F.struct(F.col("n_regionkey").cast("long").alias("chrom_id"), (n * 1000).alias("pos"), (n % 2 == 0).alias("fw"))
    reps = t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("rep_id")).agg(F.collect_list(place).alias("positions")).withColumn("consensus", F.repeat(F.lit("A"), F.lit(400)))
    path = scratch(spark, "index")
    index.write_index(path, ref, index.kmer_index(ref, 8), repeats=reps)
    return Index(spark, path)


__all__ = ["Column", "READS", "_NREF", "intervals", "minimizers_sql", "named_ref"]
