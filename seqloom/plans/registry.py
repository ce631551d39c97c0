"""Queries of the library's own operators over the driver's tables, and the SQL that gives the same rows.

Prose stands in for sequences: letters a to z by their index modulo 4. benchmark is the reference,
documents are the reads; events are places on a line (minutes) of a chromosome (user); lineitem
gives intervals (exons by order, ship days as places).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.config import LengthFunction, Options, Scoring
from ..functions.sam import flag, template_length
from ..functions.scoring import gap_penalty, max_gaps, max_intron, max_intron_noncanonical, mismatch_penalty
from ..functions.seq import reverse_complement, text_to_bases, window_rows
from ..operators import annotation, evaluate, filters, index, intervals, metrics, pairing, ranking, repeats
from ..streaming import feedback
from . import align

K, READ, TILE_STEP = 24, 100, index.TILE - index.OVERLAP
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from fewer files than there are cores; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if c in names else c for c in df.columns))


# ---- sequences ----------------------------------------------------------------------------------

_MAP = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{('ACGT' * 7)[:26]}')"
READS = f"reads AS (SELECT doc_id, {_MAP} AS seq FROM documents)"
REF = f"ref AS (SELECT item_id, {_MAP} AS seq FROM benchmark)"
INDEX = f"idx AS (SELECT item_id, p AS pos, substring(seq, p + 1, {K}) AS kmer FROM (SELECT item_id, seq, unnest(range(0, length(seq) - {K - 1})) AS p FROM ref WHERE length(seq) >= {K}))"
GRAMS = f"grams AS (SELECT doc_id, p AS rdoff, substring(seq, p + 1, {K}) AS kmer FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - {K - 1})) AS p FROM reads WHERE length(seq) >= {K}))"
HITS = "hits AS (SELECT doc_id, item_id, rdoff, pos FROM grams JOIN idx USING (kmer))"
BASE = f"WITH {READS}, {REF}, {INDEX}, {GRAMS}, {HITS}"
CHAINS = "chains AS (SELECT doc_id, item_id, pos - rdoff AS diagonal, count(*) AS hits, min(rdoff) AS first_off, max(rdoff) AS last_off FROM hits GROUP BY ALL)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, item_id, diagonal) AS rank FROM chains)"


def reads_of(spark, sf_dir) -> DataFrame:
    return spread(t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text_to_bases("text").alias("seq"))


def ref_of(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chrom_id"), text_to_bases("text").alias("seq"))


def hits_of(spark, sf_dir) -> DataFrame:
    """Seed hits of all documents: an equality join on pieces of k-mers, the index side broadcast if it was counted to be small."""
    stranded = reads_of(spark, sf_dir).select(F.col("doc_id").alias("rdid"), F.lit(0).alias("mate"), F.lit(True).alias("fw"), F.col("seq").alias("s"))
    return align.anchored_hits(stranded, ref_of(spark, sf_dir), K)


def chains_of(spark, sf_dir) -> DataFrame:
    h = hits_of(spark, sf_dir).withColumn("diagonal", F.col("pos") - F.col("rdoff"))
    return h.groupBy(F.col("rdid").alias("doc_id"), F.col("chrom_id").alias("item_id"), "diagonal").agg(F.count("*").alias("hits"), F.min("rdoff").alias("first_off"), F.max("rdoff").alias("last_off"))


@query(f"WITH {READS} SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM reads")
def revcomp_docs(spark, sf_dir):
    return reads_of(spark, sf_dir).select("doc_id", reverse_complement("seq").alias("rc"))


@query(
    f"WITH {READS} SELECT doc_id, CAST(length(seq) AS BIGINT) AS len, "
    + ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS BIGINT) AS n_{b.lower()}" for b in "ACGT")
    + " FROM reads"
)
def base_composition(spark, sf_dir):
    n = lambda b: (F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b), F.lit("")))).cast("long").alias(f"n_{b.lower()}")
    return reads_of(spark, sf_dir).select("doc_id", F.length("seq").cast("long").alias("len"), *map(n, "ACGT"))


_MASKED = "translate(regexp_replace(lower(text), '[^a-z]', 'N', 'g'), 'abcdefghijklmnopqrstuvwxyz', '" + ("ACGT" * 7)[:26] + "')"


@query(
    f"WITH m AS (SELECT doc_id, {_MASKED} AS seq FROM documents) SELECT doc_id, CAST(length(seq) - length(replace(seq, 'N', '')) AS BIGINT) AS n_count, "
    "length(seq) - length(replace(seq, 'N', '')) <= trunc(0.15 * length(seq)) AS kept FROM m"
)
def n_filter(spark, sf_dir):
    masked = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", "N"), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])
    rows = t(spark, sf_dir, "documents").select("doc_id", masked.alias("seq"))
    from ..functions.seq import count_n

    return rows.select("doc_id", count_n("seq").cast("long").alias("n_count"), filters.n_filter(F.col("seq")).alias("kept"))


@query("WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rdid FROM documents) SELECT doc_id FROM r WHERE rdid >= 100 AND rdid < 350")
def skip_upto(spark, sf_dir):
    from ..sources.reads import with_ordinal

    docs = t(spark, sf_dir, "documents").select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return filters.skip_upto(with_ordinal(docs, "rdid"), 100, 250).select("doc_id")


@query(
    "WITH s AS (SELECT item_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n, regexp_extract_all(text, '[A-Za-z]+') AS runs FROM benchmark) "
    "SELECT item_id, CAST(len(runs) AS BIGINT) AS n_runs, CAST(n AS BIGINT) AS n_letters FROM s WHERE length(array_to_string(runs, '')) = n"
)
def letter_runs(spark, sf_dir):
    runs = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    rows = t(spark, sf_dir, "benchmark").select("item_id", runs.alias("runs"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).alias("n"))
    return rows.where(F.length(F.array_join("runs", "")) == F.col("n")).select("item_id", F.size("runs").cast("long").alias("n_runs"), F.col("n").cast("long").alias("n_letters"))


_STRETCH = (
    "WITH r AS (SELECT item_id, regexp_replace(text, '[^A-Za-z]', ' ', 'g') AS seq FROM benchmark), "
    "c AS (SELECT item_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM r), "
    "m AS (SELECT item_id, p - 1 AS p FROM c WHERE substring(seq, p, 1) <> ' '), "
    "g AS (SELECT item_id, p, p - row_number() OVER (PARTITION BY item_id ORDER BY p) AS island FROM m), "
    "s AS (SELECT item_id, min(p) AS tstart, count(*) AS len FROM g GROUP BY item_id, island) "
)


def stretches_of(spark, sf_dir) -> DataFrame:
    from ..sources.annotations import stretches

    seq = F.regexp_replace(F.regexp_replace("text", "[A-Za-z]", "A"), "[^A]", "N")
    return stretches(t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chrom_id"), seq.alias("seq")))


@query(_STRETCH + "SELECT item_id, CAST(tstart AS BIGINT) AS tstart, CAST(sum(len) OVER (ORDER BY item_id, tstart) - len AS BIGINT) AS joined_start, CAST(len AS BIGINT) AS len FROM s")
def reference_stretches(spark, sf_dir):
    return stretches_of(spark, sf_dir).withColumnRenamed("chrom_id", "item_id")


_JOINED = _STRETCH + ", st AS (SELECT item_id, tstart, sum(len) OVER (ORDER BY item_id, tstart) - len AS js, len FROM s), q AS (SELECT event_id, event_id % 4000 AS joined FROM events) "
_JOINED = _JOINED.replace(") , st", "), st")


@query(_JOINED + "SELECT event_id, item_id, CAST(tstart + joined - js AS BIGINT) AS pos FROM q ASOF JOIN st ON joined >= js")
def asof_stretch(spark, sf_dir):
    q = t(spark, sf_dir, "events").select(F.col("event_id").alias("rep_id"), (F.col("event_id") % 4000).alias("joined"))
    found = repeats.place_on_chromosomes(q, stretches_of(spark, sf_dir)).where("chrom_id is not null")
    return found.select(F.col("rep_id").alias("event_id"), F.col("chrom_id").alias("item_id"), "pos")


@query(_JOINED + "SELECT event_id, item_id, CAST(tstart + joined - js AS BIGINT) AS pos FROM q JOIN st ON joined >= js AND joined + 4 <= js + len")
def joined_to_chromosome(spark, sf_dir):
    q = t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4000).alias("joined"), F.lit(4).alias("len"))
    return intervals.to_chromosome(q, stretches_of(spark, sf_dir), 64).select("event_id", F.col("chrom_id").alias("item_id"), "pos")


# ---- index, seeds, chains -----------------------------------------------------------------------


@query(f"WITH {REF}, {INDEX} SELECT kmer, item_id, CAST(pos AS BIGINT) AS pos, CAST(pos // {TILE_STEP} AS BIGINT) AS tile_id FROM idx")
def kmer_index_benchmark(spark, sf_dir):
    return index.kmer_index(ref_of(spark, sf_dir), K).withColumnRenamed("chrom_id", "item_id")


@query(f"{BASE} SELECT doc_id, item_id, CAST(rdoff AS BIGINT) AS rdoff, CAST(pos AS BIGINT) AS pos FROM hits")
def seed_hits(spark, sf_dir):
    return hits_of(spark, sf_dir).select(F.col("rdid").alias("doc_id"), F.col("chrom_id").alias("item_id"), "rdoff", "pos")


@query(
    f"{BASE}, g AS (SELECT *, pos - rdoff AS diagonal, rdoff - row_number() OVER (PARTITION BY doc_id, item_id, pos - rdoff ORDER BY rdoff) AS run FROM hits) "
    f"SELECT doc_id, item_id, CAST(diagonal AS BIGINT) AS diagonal, CAST(min(rdoff) AS BIGINT) AS rdoff, CAST(min(pos) AS BIGINT) AS pos, CAST(max(rdoff) - min(rdoff) + {K} AS BIGINT) AS len FROM g GROUP BY doc_id, item_id, diagonal, run"
)
def partial_hits(spark, sf_dir):
    p = align.partial_hits(hits_of(spark, sf_dir), K)
    return longs(p.select(F.col("rdid").alias("doc_id"), F.col("chrom_id").alias("item_id"), "diagonal", "rdoff", "pos", "len"), "len")


@query(f"{BASE}, {CHAINS} SELECT doc_id, item_id, CAST(diagonal AS BIGINT) AS diagonal, hits, CAST(first_off AS BIGINT) AS first_off, CAST(last_off AS BIGINT) AS last_off FROM chains")
def diag_chains(spark, sf_dir):
    return chains_of(spark, sf_dir)


@query(f"{BASE}, {CHAINS}, {RANKED} SELECT doc_id, item_id, CAST(diagonal AS BIGINT) AS diagonal, hits, rank FROM ranked WHERE rank = 1")
def best_alignment(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "item_id", "diagonal")
    return longs(chains_of(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank = 1").select("doc_id", "item_id", "diagonal", "hits", "rank"), "rank")


@query(
    f"{BASE}, {CHAINS}, {RANKED}, b AS (SELECT doc_id, max(hits) FILTER (rank = 1) AS best, max(hits) FILTER (rank = 2) AS second, count(*) AS n FROM ranked GROUP BY doc_id) "
    "SELECT doc_id, best, second, n, CAST(CASE WHEN second IS NULL OR second < best THEN 60 ELSE 1 END AS BIGINT) AS mapq FROM b"
)
def best_second_mapq(spark, sf_dir):
    b = ranking.best_and_second(chains_of(spark, sf_dir), ["doc_id"], "hits")
    return longs(b.withColumn("mapq", ranking.mapq(F.col("best"), F.col("second"), F.col("best"), F.lit(0))), "mapq")


@query(f"{BASE}, {CHAINS}, {RANKED} SELECT doc_id, item_id, CAST(diagonal AS BIGINT) AS diagonal, hits, rank FROM ranked WHERE rank <= 5 AND hits = (SELECT max(r.hits) FROM ranked r WHERE r.doc_id = ranked.doc_id)")
def top_ties(spark, sf_dir):
    rows = chains_of(spark, sf_dir).withColumn("tie", F.struct("item_id", "diagonal"))
    return longs(ranking.top_k(rows, ["doc_id"], 5, "hits", "tie").select("doc_id", "item_id", "diagonal", "hits", "rank"), "rank")


@query(
    f"{BASE}, {CHAINS}, n AS (SELECT d.doc_id, count(c.doc_id) AS n FROM documents d LEFT JOIN chains c USING (doc_id) GROUP BY d.doc_id) "
    "SELECT count(*) AS reads, count(*) FILTER (n = 0) AS aligned_0, count(*) FILTER (n = 1) AS aligned_1, count(*) FILTER (n > 1) AS aligned_more FROM n"
)
def alignment_summary(spark, sf_dir):
    c = chains_of(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    per = t(spark, sf_dir, "documents").select("doc_id").join(c, "doc_id", "left").select(F.lit(False).alias("paired"), F.lit("unpaired").alias("category"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).alias("n1"), F.lit(0).alias("n2"))
    m = metrics.reporting(per)
    return m.select(F.col("nread").alias("reads"), F.col("nunp_0").alias("aligned_0"), F.col("nunp_uni1").alias("aligned_1"), F.col("nunp_uni2").alias("aligned_more"))


@query(f"{BASE} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)")
def mapped_docs(spark, sf_dir):
    return evaluate.split_mapped(t(spark, sf_dir, "documents").select("doc_id", "source"), hits_of(spark, sf_dir).select(F.col("rdid").alias("doc_id")), "doc_id")[0]


@query(f"{BASE} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)")
def unmapped_docs(spark, sf_dir):
    return evaluate.split_mapped(t(spark, sf_dir, "documents").select("doc_id", "source"), hits_of(spark, sf_dir).select(F.col("rdid").alias("doc_id")), "doc_id")[1]


@query(f"WITH {READS}, {GRAMS} SELECT kmer, count(*) AS n, count(DISTINCT doc_id) AS docs FROM grams GROUP BY kmer HAVING count(DISTINCT doc_id) >= 5")
def repeat_kmers(spark, sf_dir):
    # k-mers are moved once, and both counts are taken where they lie
    grams = intervals.dealt(window_rows(reads_of(spark, sf_dir), ["doc_id"], "seq", K).select("kmer", "doc_id"), "kmer")
    per = grams.groupBy("kmer", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where("docs >= 5")


@query(
    f"WITH {REF}, c AS (SELECT item_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM ref), n AS (SELECT p - 1 AS pos, substring(seq, p, 1) AS base, count(*) AS n FROM c GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) AS k FROM n) SELECT string_agg(base, '' ORDER BY pos) AS consensus FROM r WHERE k = 1"
)
def majority_consensus(spark, sf_dir):
    cells = window_rows(ref_of(spark, sf_dir), [], "seq", 1).select(F.lit(0).alias("rep_id"), "pos", F.col("kmer").alias("base"))
    return repeats.consensus(cells).select("consensus")


@query("SELECT count(*) AS cnt, min(length(text)) AS min, max(length(text)) AS max, CAST(sum(length(text)) // count(*) AS BIGINT) AS avg FROM documents WHERE text IS NOT NULL")
def read_length_stats(spark, sf_dir):
    return metrics.read_lengths(t(spark, sf_dir, "documents").select(F.col("text").alias("seq"))).drop("lengths")


# ---- scalar functions ---------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(2 + trunc(least(l_quantity, 40) / 40.0 * 4) AS BIGINT) AS penalty FROM lineitem")
def mismatch_score(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mismatch_penalty(F.col("l_quantity")).cast("long").alias("penalty"))


@query(
    "SELECT doc_id, CAST(trunc(-0.2 * n_chars) AS BIGINT) AS linear, CAST(trunc(greatest(-8 + ln(greatest(n_chars, 1)), 0)) AS BIGINT) AS logarithm, CAST(trunc(least(1 + 2 * sqrt(n_chars), 100)) AS BIGINT) AS root FROM documents"
)
def length_functions(spark, sf_dir):
    n = F.greatest("n_chars", F.lit(1))
    return t(spark, sf_dir, "documents").select(
        "doc_id",
        LengthFunction.parse("L,0,-0.2").whole(F.col("n_chars")).alias("linear"),
        LengthFunction("G", -8.0, 1.0, 0.0).whole(n).alias("logarithm"),
        LengthFunction("S", 1.0, 2.0, high=100.0).whole(F.col("n_chars")).alias("root"),
    )


@query(
    "SELECT p_partkey, CAST(CASE WHEN p_size >= 8 THEN floor((p_size - 5) / 3.0) ELSE 0 END AS BIGINT) AS gaps, CAST(5 + 3 * p_size AS BIGINT) AS penalty, "
    "CAST(CASE WHEN p_size >= 7 THEN 1 << CAST(least(greatest(2 * p_size - 4, 13), 30) AS INTEGER) ELSE 0 END AS BIGINT) AS intron, "
    "CAST(CASE WHEN p_size >= 14 THEN 1 << CAST(least(2 * p_size - 10, 30) AS INTEGER) ELSE 0 END AS BIGINT) AS noncanonical FROM part"
)
def gap_limits(spark, sf_dir):
    p = F.col("p_size")
    return t(spark, sf_dir, "part").select(
        "p_partkey",
        max_gaps(-p, F.lit(100)).cast("long").alias("gaps"),
        gap_penalty(p).cast("long").alias("penalty"),
        max_intron(p).cast("long").alias("intron"),
        max_intron_noncanonical(p).cast("long").alias("noncanonical"),
    )


@query(
    "SELECT event_id, CAST(1 + (CASE WHEN user_id % 2 = 0 AND event_id % 3 <> 0 THEN 2 ELSE 0 END) + (CASE WHEN event_id % 3 = 0 THEN 4 ELSE 0 END) + (CASE WHEN event_id % 5 = 0 THEN 8 ELSE 0 END) "
    "+ (CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 1 THEN 16 ELSE 0 END) + (CASE WHEN event_id % 5 <> 0 AND event_id % 7 = 0 THEN 32 ELSE 0 END) + (CASE WHEN event_id % 2 = 0 THEN 64 ELSE 128 END) + (CASE WHEN event_id % 3 <> 0 AND event_id % 11 = 0 THEN 256 ELSE 0 END) AS BIGINT) AS flag FROM events"
)
def flag_bits(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    f = flag(F.lit(True), u % 2 == 0, e % 3 != 0, e % 5 != 0, e % 2 == 0, e % 7 != 0, F.when(e % 2 == 0, 1).otherwise(2), e % 11 == 0)
    return t(spark, sf_dir, "events").select("event_id", f.cast("long").alias("flag"))


_DAY = "datediff('day', TIMESTAMP '1992-01-01', l_shipdate)"
_PAIRS = f"WITH l AS (SELECT l_orderkey, l_linenumber, {_DAY} AS pos, CAST(l_quantity AS BIGINT) AS len, l_returnflag = 'A' OR l_linestatus = 'O' AS fw FROM lineitem), p AS (SELECT a.l_orderkey, a.pos AS p1, a.len AS n1, a.fw AS f1, b.pos AS p2, b.len AS n2, b.fw AS f2 FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2) "


def places_of(spark, sf_dir) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    fw = (F.col("l_returnflag") == "A") | (F.col("l_linestatus") == "O")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", day.alias("pos"), F.col("l_quantity").cast("long").alias("len"), fw.alias("fw"))


def line_pairs(spark, sf_dir) -> DataFrame:
    l = places_of(spark, sf_dir)
    a = l.where("l_linenumber = 1").select("l_orderkey", F.col("pos").alias("p1"), F.col("len").alias("n1"), F.col("fw").alias("f1"))
    b = l.where("l_linenumber = 2").select("l_orderkey", F.col("pos").alias("p2"), F.col("len").alias("n2"), F.col("fw").alias("f2"))
    return a.join(b, "l_orderkey")


@query(
    _PAIRS + "SELECT l_orderkey, CASE WHEN f1 = f2 OR greatest(p1 + n1, p2 + n2) - least(p1, p2) > 1000 THEN 'DISCORD' "
    "WHEN NOT (p1 <= p2 + n2 - 1 AND p2 <= p1 + n1 - 1) AND ((f1 AND p2 < p1) OR (NOT f1 AND p1 < p2)) THEN 'DISCORD' "
    "WHEN (f1 AND (p1 + n1 > p2 + n2 OR p2 < p1)) OR (NOT f1 AND (p2 + n2 > p1 + n1 OR p1 < p2)) THEN 'DISCORD' "
    "WHEN (p1 >= p2 AND p1 + n1 <= p2 + n2) OR (p2 >= p1 AND p2 + n2 <= p1 + n1) THEN 'CONTAIN' WHEN p1 <= p2 + n2 - 1 AND p2 <= p1 + n1 - 1 THEN 'OVERLAP' ELSE 'NORMAL' END AS class FROM p"
)
def pair_class(spark, sf_dir):
    c = pairing.pair_class(F.col("p1"), F.col("n1"), F.col("f1"), F.col("p2"), F.col("n2"), F.col("f2"))
    return line_pairs(spark, sf_dir).select("l_orderkey", c.alias("class"))


@query(_PAIRS + "SELECT l_orderkey, CAST(CASE WHEN p1 <= p2 THEN 1 ELSE -1 END * (greatest(p1 + n1, p2 + n2) - least(p1, p2)) AS BIGINT) AS tlen FROM p")
def tlen(spark, sf_dir):
    p = line_pairs(spark, sf_dir)
    return p.select("l_orderkey", template_length(F.col("p1"), F.col("p1") + F.col("n1"), F.col("p2"), F.col("p2") + F.col("n2"), F.lit(True)).cast("long").alias("tlen"))


@query(_PAIRS + "SELECT l_orderkey, CAST(CASE WHEN f1 THEN p1 ELSE p1 + n1 - 1000 END AS BIGINT) AS first, CAST(CASE WHEN f1 THEN p1 + 1000 - n2 ELSE p1 + n1 - n2 END AS BIGINT) AS last, NOT f1 AS fw FROM p")
def mate_window(spark, sf_dir):
    first, last, fw = pairing.mate_window(F.col("p1"), F.col("n1"), F.col("f1"), F.col("n2"), F.lit(1))
    return line_pairs(spark, sf_dir).select("l_orderkey", first.cast("long").alias("first"), last.cast("long").alias("last"), fw.alias("fw"))


@query(
    _PAIRS + "SELECT CASE WHEN p1 <= p2 THEN (CASE WHEN f1 THEN 'F' ELSE 'R' END) || (CASE WHEN f2 THEN 'F' ELSE 'R' END) ELSE (CASE WHEN f2 THEN 'F' ELSE 'R' END) || (CASE WHEN f1 THEN 'F' ELSE 'R' END) END AS orientation, "
    "CAST((greatest(p1 + n1, p2 + n2) - least(p1, p2)) // 10 * 10 AS BIGINT) AS fraglen, count(*) AS n FROM p GROUP BY ALL"
)
def fragment_lengths(spark, sf_dir):
    p = line_pairs(spark, sf_dir).select(*(F.lit(0).alias(f"chrom{k}") for k in (1, 2)), *(F.lit(60).alias(f"mapq{k}") for k in (1, 2)), *(F.col(f"p{k}").alias(f"pos{k}") for k in (1, 2)), *((F.col(f"p{k}") + F.col(f"n{k}") - 1).alias(f"end{k}") for k in (1, 2)), *(F.col(f"f{k}").alias(f"fw{k}") for k in (1, 2)))
    return longs(pairing.fragment_length(p), "fraglen")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def name_distance(spark, sf_dir):
    """Names of a brand and size are compared once, however many parts have them."""
    p = t(spark, sf_dir, "part").where("p_partkey is not null").groupBy("p_brand", "p_size", "p_name").agg(F.collect_list("p_partkey").alias("keys"))
    p = intervals.dealt(p, "p_brand", "p_size")
    a, b = p.alias("a"), p.alias("b")
    # two names meet once; a missing one stands before all others
    ordered = F.coalesce(F.col("a.p_name") <= F.col("b.p_name"), F.col("a.p_name").isNull())
    j = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & ordered)
    j = j.select(F.col("a.p_name").eqNullSafe(F.col("b.p_name")).alias("same"), F.levenshtein("a.p_name", "b.p_name").cast("long").alias("distance"), F.col("a.keys").alias("x"), F.col("b.keys").alias("y"))
    j = j.select("same", "distance", F.explode("x").alias("x"), "y").select("same", "distance", "x", F.explode("y").alias("y"))
    j = j.where(F.when(F.col("same"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    return j.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


# ---- intervals and annotation -------------------------------------------------------------------

_EXONS = f"ex AS (SELECT l_orderkey AS tid, {_DAY} AS lft, {_DAY} + CAST(l_quantity AS BIGINT) AS rgt, l_linestatus AS strand, l_linenumber FROM lineitem)"
_MERGED = "mk AS (SELECT *, CASE WHEN lft - lag(rgt) OVER w <= 5 THEN 0 ELSE 1 END AS fresh FROM ex WINDOW w AS (PARTITION BY tid ORDER BY lft, rgt, l_linenumber)), gr AS (SELECT *, sum(fresh) OVER (PARTITION BY tid ORDER BY lft, rgt, l_linenumber) AS island FROM mk), me AS (SELECT tid, island, min(lft) AS lft, arg_max(rgt, (lft, rgt)) AS rgt FROM gr GROUP BY tid, island)"


def exons_of(spark, sf_dir) -> DataFrame:
    l = places_of(spark, sf_dir)
    return l.select(F.col("l_orderkey").alias("transcript_id"), (F.col("l_orderkey") % 50).alias("chrom"), F.col("pos").alias("left"), (F.col("pos") + F.col("len")).alias("right"), F.lit("+").alias("strand"), (F.col("l_orderkey") % 500).alias("gene_id"))


@query(f"WITH {_EXONS}, {_MERGED}, j AS (SELECT tid % 50 AS chrom, lag(rgt) OVER (PARTITION BY tid ORDER BY lft, rgt) - 1 AS l, lft - 1 AS r FROM me) SELECT DISTINCT chrom, CAST(l AS BIGINT) AS \"left\", CAST(r AS BIGINT) AS \"right\", '+' AS strand FROM j WHERE l IS NOT NULL")
def junctions_from_exons(spark, sf_dir):
    return annotation.splice_sites(exons_of(spark, sf_dir))


@query(
    f"WITH {_EXONS}, {_MERGED}, d AS (SELECT DISTINCT tid % 50 AS chrom, lft, rgt FROM me), k AS (SELECT *, CASE WHEN max(rgt) OVER (PARTITION BY chrom ORDER BY lft, rgt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < lft THEN 1 ELSE 0 END AS fresh FROM d), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY lft, rgt) AS island FROM k) SELECT chrom, CAST(min(lft) - 1 AS BIGINT) AS \"left\", CAST(max(rgt) - 1 AS BIGINT) AS \"right\", '+' AS strand FROM g GROUP BY chrom, island"
)
def merged_exons(spark, sf_dir):
    return annotation.merged_exons(exons_of(spark, sf_dir))


@query(
    f"WITH {_EXONS}, {_MERGED}, s AS (SELECT *, lft - lag(rgt) OVER (PARTITION BY tid ORDER BY lft, rgt) AS intron FROM me), p AS (SELECT tid % 500 AS gene, tid, sum(rgt - lft + 1) AS len, count(*) AS n, sum(intron) AS i, count(intron) AS ni FROM s GROUP BY tid), "
    "g AS (SELECT gene, count(*) AS t, sum(len) AS len, sum(n) AS n, sum(i) AS i, sum(ni) AS ni FROM p GROUP BY gene) SELECT count(*) AS genes, count(*) FILTER (t > 1) AS genes_multi, CAST(sum(t) AS BIGINT) AS transcripts, CAST(sum(len) // sum(t) AS BIGINT) AS transcript_avg, CAST(sum(n) AS BIGINT) AS exons, CAST(sum(len) // sum(n) AS BIGINT) AS exon_avg, CAST(sum(ni) AS BIGINT) AS introns, CAST(sum(i) // sum(ni) AS BIGINT) AS intron_avg, CAST(sum(n) // sum(t) AS BIGINT) AS exons_per_transcript FROM g"
)
def annotation_stats(spark, sf_dir):
    return metrics.annotation_stats(annotation.merged_transcript_exons(exons_of(spark, sf_dir)))


_MINUTE = "CAST(floor(epoch(ts) / 60) AS BIGINT)"
_EVENTS = f"ev AS (SELECT event_id, user_id, event_type, {_MINUTE} AS mi, value FROM events)"


def minutes_of(spark, sf_dir) -> DataFrame:
    at = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 60).cast("long")
    return t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("chrom_id"), "event_type", at.alias("at"), "value")


_CONTAIN = f"{_EXONS}, x AS (SELECT tid % 50 AS chrom, tid, l_linenumber AS ln, lft, rgt FROM ex), q AS (SELECT p_partkey, p_partkey % 50 AS chrom, p_partkey % 2500 AS l, p_partkey % 2500 + p_size AS r FROM part)"


@query(f"WITH {_CONTAIN} SELECT DISTINCT p_partkey FROM q JOIN x ON q.chrom = x.chrom AND x.lft <= q.l AND q.r <= x.rgt")
def exon_containment(spark, sf_dir):
    q = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("chrom_id"), (F.col("p_partkey") % 2500).alias("l_start"), (F.col("p_partkey") % 2500 + F.col("p_size")).alias("l_end"))
    x = exons_of(spark, sf_dir).select(F.col("chrom").alias("chrom_id"), F.col("left").alias("r_start"), F.col("right").alias("r_end"))
    return intervals.contained(q, x, ["chrom_id"]).select("p_partkey")


@query(f"WITH {_CONTAIN} SELECT p_partkey, tid AS l_orderkey, CAST(ln AS BIGINT) AS l_linenumber FROM q JOIN x ON q.chrom = x.chrom AND x.lft <= q.r AND q.l <= x.rgt")
def interval_overlaps(spark, sf_dir):
    q = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("chrom_id"), (F.col("p_partkey") % 2500).alias("l_start"), (F.col("p_partkey") % 2500 + F.col("p_size")).alias("l_end"))
    x = places_of(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_orderkey") % 50).alias("chrom_id"), F.col("pos").alias("r_start"), (F.col("pos") + F.col("len")).alias("r_end"))
    return intervals.overlap_join(q, x, ["chrom_id"], 64, many=True).select("p_partkey", "l_orderkey", "l_linenumber")


_SITES = f"{_EVENTS}, si AS (SELECT event_id AS sid, user_id, mi AS l, mi + 60 AS r FROM ev WHERE event_type = 'purchase'), q AS (SELECT event_id, user_id, mi FROM ev WHERE event_type <> 'purchase')"


def sites_of(spark, sf_dir) -> DataFrame:
    return minutes_of(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("sid"), "chrom_id", F.col("at").alias("left"), (F.col("at") + 60).alias("right"))


def places_asked(spark, sf_dir) -> DataFrame:
    return minutes_of(spark, sf_dir).where("event_type <> 'purchase'").select("event_id", "chrom_id", "at")


@query(f"WITH {_SITES} SELECT event_id, sid FROM q JOIN si ON q.user_id = si.user_id AND r BETWEEN mi - 2879 AND mi")
def splice_range_left(spark, sf_dir):
    return intervals.sites_left(places_asked(spark, sf_dir), sites_of(spark, sf_dir), 2880).select("event_id", "sid")


@query(f"WITH {_SITES} SELECT event_id, sid FROM q JOIN si ON q.user_id = si.user_id AND l BETWEEN mi AND mi + 2879")
def splice_range_right(spark, sf_dir):
    return intervals.sites_right(places_asked(spark, sf_dir), sites_of(spark, sf_dir), 2880).select("event_id", "sid")


@query(f"WITH {_SITES} SELECT event_id FROM q WHERE EXISTS (SELECT 1 FROM si WHERE si.user_id = q.user_id AND l BETWEEN mi - 1440 AND mi AND r BETWEEN mi AND mi + 1440)")
def any_site(spark, sf_dir):
    q = places_asked(spark, sf_dir).select("event_id", "chrom_id", (F.col("at") - 1440).alias("l1"), F.col("at").alias("r1"), F.col("at").alias("l2"), (F.col("at") + 1440).alias("r2"))
    return intervals.any_site(q, sites_of(spark, sf_dir), 2048).select("event_id")


@query(f"WITH {_EVENTS} SELECT event_id, mi AS start, CAST(mi + event_id % 600 AS BIGINT) AS \"end\", CAST(max(mi + event_id % 600) OVER (PARTITION BY user_id ORDER BY mi, mi + event_id % 600 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS max_end FROM ev")
def prefix_max_ends(spark, sf_dir):
    rows = minutes_of(spark, sf_dir).select("event_id", "chrom_id", F.col("at").alias("start"), (F.col("at") + F.col("event_id") % 600).alias("end"))
    return intervals.prefix_max_ends(rows, ["chrom_id"]).drop("chrom_id")


@query(
    f"WITH {_EVENTS}, i AS (SELECT user_id, mi AS s, mi + event_id % 600 AS e FROM ev), k AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 THEN 0 ELSE 1 END AS fresh FROM i), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM k) SELECT user_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS \"end\", count(*) AS n FROM g GROUP BY user_id, island"
)
def interval_merge(spark, sf_dir):
    rows = minutes_of(spark, sf_dir).select(F.col("chrom_id").alias("user_id"), F.col("at").alias("start"), (F.col("at") + F.col("event_id") % 600).alias("end"))
    return intervals.merge(rows, ["user_id"], gap=30)


@query(f"WITH {_EVENTS} SELECT a.user_id, a.event_id AS id_a, b.event_id AS id_b, CAST(abs(a.mi - b.mi) AS BIGINT) AS apart FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.mi - b.mi) <= 600")
def near_pairs(spark, sf_dir):
    rows = minutes_of(spark, sf_dir).select(F.col("chrom_id").alias("user_id"), F.col("event_id").alias("id"), F.col("at").alias("pos"))
    return intervals.near_pairs(rows, ["user_id"], 600)


@query(
    f"WITH {_EVENTS}, s AS (SELECT DISTINCT user_id, mi FROM ev WHERE event_type = 'purchase') SELECT q.event_id, s.mi AS \"last\" FROM (SELECT * FROM ev WHERE event_type <> 'purchase') q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.mi >= s.mi"
)
def asof_purchase(spark, sf_dir):
    s = sites_of(spark, sf_dir).select("chrom_id", F.col("left").alias("last")).distinct()
    return intervals.asof(places_asked(spark, sf_dir), s, ["chrom_id"], "at", "last", ["last"]).select("event_id", "last")


_VARIANTS = "v AS (SELECT l_partkey AS id, l_orderkey % 20 AS chrom, l_suppkey * 40 + l_linenumber * 7 AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'D' ELSE 'I' END AS type, CASE l_linenumber % 3 WHEN 0 THEN substring('ACGT', CAST(l_quantity AS INTEGER) % 4 + 1, 1) WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) % 5 + 1 AS VARCHAR) ELSE 'AC' END AS data FROM lineitem)"
_DEDUP = "d AS (SELECT chrom, pos, type, data, min(id) AS id FROM v GROUP BY chrom, pos, type, data)"
_VORDER = "chrom, pos, CASE type WHEN 'I' THEN 0 WHEN 'S' THEN 1 ELSE 2 END, CASE WHEN type = 'D' THEN CAST(data AS BIGINT) END, data"


def variants_of(spark, sf_dir) -> DataFrame:
    n, q = F.col("l_linenumber") % 3, F.col("l_quantity").cast("int")
    return t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"),
        (F.col("l_orderkey") % 20).alias("chrom"),
        (F.col("l_suppkey") * 40 + F.col("l_linenumber") * 7).alias("pos"),
        F.when(n == 0, "S").when(n == 1, "D").otherwise("I").alias("type"),
        F.when(n == 0, F.substring(F.lit("ACGT"), q % 4 + 1, F.lit(1))).when(n == 1, (q % 5 + 1).cast("string")).otherwise("AC").alias("data"),
    )


@query(
    f"WITH {_VARIANTS}, {_DEDUP}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS c, row_number() OVER (PARTITION BY id ORDER BY {_VORDER} NULLS FIRST) - 1 AS k FROM d) "
    "SELECT chrom, pos, type, data, id, CASE WHEN c > 1 THEN id || '.' || k ELSE CAST(id AS VARCHAR) END AS id2 FROM n"
)
def variant_dedup_suffix(spark, sf_dir):
    return annotation.suffix_ids(annotation.distinct_variants(variants_of(spark, sf_dir))).select("chrom", "pos", "type", "data", "id", "id2")


@query(
    f"WITH {_VARIANTS}, {_DEDUP}, e AS (SELECT *, pos + CASE WHEN type = 'D' THEN CAST(data AS BIGINT) - 1 ELSE 0 END AS fin FROM d), k AS (SELECT *, CASE WHEN max(fin) OVER (PARTITION BY chrom ORDER BY {_VORDER[7:]} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 < pos THEN 1 ELSE 0 END AS fresh FROM e), "
    f"g AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY {_VORDER[7:]} NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM k) SELECT chrom, CAST(min(pos) AS BIGINT) AS start, CAST(max(fin) AS BIGINT) AS \"end\", count(*) AS n FROM g GROUP BY chrom, island"
)
def haplotype_islands(spark, sf_dir):
    c = annotation.clusters(annotation.distinct_variants(variants_of(spark, sf_dir)), 30)
    end = F.col("pos") + F.when(F.col("type") == "D", F.col("data").try_cast("long") - 1).otherwise(0)
    return c.groupBy("chrom", "cluster").agg(F.min("pos").alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("cluster")


_ALLELES = "a AS (SELECT p_partkey, substring(upper(p_name), 1, 1 + CAST(p_size % 3 AS INTEGER)) AS ref, substring(upper(p_name), 1, 1 + CAST(p_partkey % 4 AS INTEGER)) AS alt, p_partkey AS pos FROM part)"


@query(
    f"WITH {_ALLELES}, n AS (SELECT *, length(ref) AS r, length(alt) AS l FROM a WHERE position('N' IN alt) = 0) SELECT p_partkey, CASE WHEN r = l THEN 'S' WHEN r < l THEN 'I' ELSE 'D' END AS type, "
    "CAST(CASE WHEN r = l THEN pos ELSE pos + least(r, l) END AS BIGINT) AS pos, CASE WHEN r < l THEN substring(alt, r + 1, 99) ELSE CAST(r - l AS VARCHAR) END AS data FROM n WHERE r <> l"
)
def variant_normalise(spark, sf_dir):
    up = F.upper("p_name")
    rows = t(spark, sf_dir, "part").select("p_partkey", F.substring(up, F.lit(1), F.lit(1) + (F.col("p_size") % 3).cast("int")).alias("ref"), F.substring(up, F.lit(1), F.lit(1) + (F.col("p_partkey") % 4).cast("int")).alias("alt"))
    return rows.withColumn("v", annotation.normalise(F.col("ref"), F.col("alt"), F.col("p_partkey"))).where("v is not null").select("p_partkey", "v.type", "v.pos", "v.data")


# ---- splice-site support, junctions, alleles ----------------------------------------------------

_USES = "u AS (SELECT l_orderkey AS rdid, l_suppkey % 25 AS chrom_id, l_partkey % 100 * 50 AS l, l_partkey % 100 * 50 + 1000 AS r, CAST(l_quantity AS BIGINT) AS la, 51 - CAST(l_quantity AS BIGINT) AS ra, l_linenumber % 3 AS mm, l_returnflag <> 'R' AS can FROM lineitem)"
_SUPPORT = "s AS (SELECT chrom_id, l, r, max(la) AS left_ext, max(ra) AS right_ext, min(mm) AS edit_dist, count(*) AS num_reads, min(rdid) AS first_rdid FROM u WHERE least(la, ra) >= 15 + 2 * mm + CASE WHEN can THEN 0 ELSE 6 END GROUP BY chrom_id, l, r)"


def uses_of(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    left = F.col("l_partkey") % 100 * 50
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rdid"), (F.col("l_suppkey") % 25).alias("chrom_id"), left.alias("left"), (left + 1000).alias("right"), F.lit(True).alias("fw"), q.alias("left_anchor"), (51 - q).alias("right_anchor"), (F.col("l_linenumber") % 3).cast("long").alias("mismatches"), (F.col("l_returnflag") != "R").alias("canonical"))


@query(f"WITH {_USES}, {_SUPPORT} SELECT chrom_id, l AS \"left\", r AS \"right\", left_ext, right_ext, CAST(edit_dist AS BIGINT) AS edit_dist, num_reads, first_rdid FROM s")
def site_support(spark, sf_dir):
    return metrics.site_support(uses_of(spark, sf_dir)).drop("fw")


@query(f"WITH {_USES}, {_SUPPORT}, c AS (SELECT least(num_reads, 99) AS k, count(*) AS n FROM s GROUP BY 1), f AS (SELECT k, sum(n) OVER (ORDER BY k) / sum(n) OVER () AS share FROM c) SELECT CAST(coalesce(min(k) FILTER (share > 0.7), 0) AS BIGINT) AS cutoff FROM f")
def site_cdf_cutoff(spark, sf_dir):
    return longs(metrics.support_cutoff(metrics.site_support(uses_of(spark, sf_dir))), "cutoff")


@query(
    f"WITH {_USES}, {_SUPPORT}, j AS (SELECT s.*, k.l AS kl, k.r AS kr FROM s LEFT JOIN (SELECT DISTINCT chrom_id, l + 3 AS l, r + 3 AS r FROM s WHERE num_reads > 2) k ON s.chrom_id = k.chrom_id AND abs(s.l - k.l) <= 5 AND s.l - k.l = s.r - k.r) SELECT chrom_id AS chrom, l AS \"left\", r AS \"right\", kl AS known_left, kr AS known_right FROM j"
)
def junction_matches(spark, sf_dir):
    s = metrics.site_support(uses_of(spark, sf_dir)).select(F.col("chrom_id").alias("chrom"), "left", "right", "num_reads")
    known = s.where("num_reads > 2").select("chrom", (F.col("left") + 3).alias("left"), (F.col("right") + 3).alias("right"))
    return evaluate.junction_matches(s.drop("num_reads"), known)


@query(f"WITH {_USES}, f AS (SELECT chrom_id, l, r, min(rdid) AS first_rdid FROM u GROUP BY chrom_id, l, r), q AS (SELECT o_orderkey AS rdid, o_custkey % 25 AS chrom_id FROM orders) SELECT q.rdid, q.chrom_id, count(f.l) AS seen FROM q LEFT JOIN f ON f.chrom_id = q.chrom_id AND f.first_rdid + 2000 <= q.rdid GROUP BY q.rdid, q.chrom_id")
def visible_sites(spark, sf_dir):
    q = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rdid"), (F.col("o_custkey") % 25).alias("chrom_id"))
    return feedback.newest_before(q, feedback.first_found(uses_of(spark, sf_dir)), threads=2)


_ALLELES = (
    "al AS (SELECT DISTINCT n_nationkey % 8 AS allele, n_regionkey AS variant FROM nation), sh AS (SELECT DISTINCT l_orderkey AS aln, l_linenumber % 5 AS variant FROM lineitem), "
    "n AS (SELECT aln, count(*) AS n FROM sh GROUP BY aln), names AS (SELECT DISTINCT allele FROM al), h AS (SELECT aln, allele, count(*) AS k FROM sh JOIN al USING (variant) GROUP BY aln, allele), "
    "s AS (SELECT n.aln, names.allele, -2.0 * (n - coalesce(k, 0)) AS s FROM n CROSS JOIN names LEFT JOIN h ON h.aln = n.aln AND h.allele = names.allele), "
    "pairs AS (SELECT CAST(a.allele AS BIGINT) AS allele_a, CAST(b.allele AS BIGINT) AS allele_b, round(sum(ln((exp(a.s) + exp(b.s)) / 2 + 0.001)), 4) AS log_likelihood FROM s a JOIN s b ON a.aln = b.aln AND a.allele <= b.allele GROUP BY 1, 2)"
)


def shown_alleles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    al = t(spark, sf_dir, "nation").select((F.col("n_nationkey") % 8).cast("long").alias("allele"), F.col("n_regionkey").alias("variant")).distinct()
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("aln_id"), (F.col("l_linenumber") % 5).alias("variant")).distinct(), al


@query(f"WITH {_ALLELES} SELECT * FROM pairs")
def allele_likelihood(spark, sf_dir):
    return metrics.allele_likelihood(*shown_alleles(spark, sf_dir)).withColumn("log_likelihood", F.round("log_likelihood", 4))


@query(f"WITH {_ALLELES} SELECT * FROM pairs ORDER BY log_likelihood DESC, allele_a, allele_b LIMIT 1")
def typed_alleles(spark, sf_dir):
    """The best pair of alleles."""
    return metrics.typed_pair(*shown_alleles(spark, sf_dir))


_RULES = "SELECT o_orderkey AS rdid, o_custkey % 3 AS nc, o_orderkey % 4 AS n1, o_custkey % 4 AS n2 FROM orders"


@query(f"SELECT rdid, CASE WHEN nc > 1 THEN 'concordant' WHEN n1 = 1 AND n2 = 1 THEN 'discordant' WHEN n1 > 0 OR n2 > 0 THEN 'unpaired' ELSE 'none' END AS category FROM ({_RULES})")
def pair_category(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    c = ranking.category(F.col("o_custkey") % 3 - 1, F.col("o_orderkey") % 4, F.col("o_custkey") % 4)
    return o.select(F.col("o_orderkey").alias("rdid"), c.alias("category"))


@query("WITH h AS (SELECT event_id, user_id % 25 AS rep, event_id % 500 AS p FROM events), c AS (SELECT n_nationkey AS rep, n_regionkey AS chrom_id, n_nationkey * 1000 AS pos, n_nationkey % 2 = 0 AS fw FROM nation) SELECT event_id, CAST(c.chrom_id AS BIGINT) AS chrom_id, CAST(CASE WHEN fw THEN c.pos + p ELSE c.pos + 400 - p - 20 END AS BIGINT) AS pos, fw FROM h JOIN c USING (rep) WHERE p + 20 <= 400")
def repeat_expand(spark, sf_dir):
    hits = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("rep_id"), (F.col("event_id") % 500).alias("pos"), F.lit(20).alias("len"))
    n = F.col("n_nationkey").cast("long")
    reps = t(spark, sf_dir, "nation").groupBy(n.alias("rep_id")).agg(F.collect_list(F.struct(F.col("n_regionkey").cast("long").alias("chrom_id"), (n * 1000).alias("pos"), (n % 2 == 0).alias("fw"))).alias("positions")).withColumn("consensus", F.repeat(F.lit("A"), F.lit(400)))
    return repeats.expand(hits, reps).select("event_id", "chrom_id", "pos", "fw")


# ---- queries that SQL does not express ------------------------------------------------------------


def alignments_of(spark, sf_dir, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    ref = t(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("chrom"), F.col("item_id").alias("chrom_id"), text_to_bases("text").alias("seq"))
    starts = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1, F.lit(READ)))
    pieces = reads_of(spark, sf_dir).select("doc_id", "seq", F.explode(starts).alias("at")).select("doc_id", "at", F.substring("seq", F.col("at") + 1, F.lit(READ)).alias("seq"))
    rdid = F.shiftrightunsigned(F.xxhash64("doc_id", "at"), 1)
    reads = pieces.select(rdid.alias("rdid"), F.lit(0).alias("mate"), F.concat_ws("_", F.lit("d"), "doc_id", "at").alias("name"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"), F.lit(None).cast("string").alias("filter"))
    return reads, align.align(reads, ref, index.kmer_index(ref, o.kmer), o), ref


@query()
def gapped_alignments(spark, sf_dir):
    """All documents, cut into reads of READ bases, aligned with gaps to benchmark."""
    o = Options(kmer=K, spliced=False, norc=True)
    reads, alns, ref = alignments_of(spark, sf_dir, o)
    return alns.select("rdid", "chrom_id", "pos", "fw", "score", "cigar", "md")


@query()
def sam_lines(spark, sf_dir):
    """The same as records with their tags."""
    from ..sources.sinks import sam_records

    o = Options(kmer=K, spliced=False, norc=True, no_unal=True)
    reads, alns, ref = alignments_of(spark, sf_dir, o)
    return sam_records(align.report(reads, alns, ref, o), o)


@query()
def greedy_haplotypes(spark, sf_dir):
    rows = variants_of(spark, sf_dir).withColumn("freq", F.lit(0.05)).withColumn("id", F.col("id").cast("string"))
    return annotation.haplotypes(rows)


@query(
    f"WITH RECURSIVE {_USES}, j AS (SELECT DISTINCT chrom_id AS chrom, l + rdid % 4 AS l, r - l AS size FROM u), n AS (SELECT a.chrom, a.size, a.l, min(b.l) AS next FROM j a LEFT JOIN j b ON a.chrom = b.chrom AND a.size = b.size AND b.l > a.l + 10 GROUP BY a.chrom, a.size, a.l), "
    "k(chrom, size, l) AS (SELECT chrom, size, min(l) FROM j GROUP BY chrom, size UNION ALL SELECT k.chrom, k.size, n.next FROM k JOIN n ON n.chrom = k.chrom AND n.size = k.size AND n.l = k.l WHERE n.next IS NOT NULL) SELECT chrom, l AS \"left\", l + size AS \"right\" FROM k"
)
def greedy_junctions(spark, sf_dir):
    return evaluate.distinct_junctions(uses_of(spark, sf_dir).select(F.col("chrom_id").alias("chrom"), (F.col("left") + F.col("rdid") % 4).alias("left"), (F.col("right") + F.col("rdid") % 4).alias("right")))


@query(
    f"WITH {_USES}, {_SUPPORT}, c AS (SELECT least(num_reads, 99) AS k, count(*) AS n FROM s GROUP BY 1), f AS (SELECT k, sum(n) OVER (ORDER BY k) / sum(n) OVER () AS share FROM c), cut AS (SELECT coalesce(min(k) FILTER (share > 0.7), 0) AS cutoff, (SELECT count(*) // 100000 FROM s) AS floor FROM f), "
    "good AS (SELECT s.* FROM s, cut WHERE num_reads >= cutoff OR (edit_dist = 0 AND num_reads >= floor)), m AS (SELECT *, CASE WHEN l - lag(l) OVER w <= 10 AND abs(r - lag(r) OVER w) <= 10 THEN 0 ELSE 1 END AS fresh FROM good WINDOW w AS (PARTITION BY chrom_id ORDER BY l, r)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom_id ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS grp FROM m), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY chrom_id, grp ORDER BY num_reads DESC, edit_dist, l, r) AS n FROM g) SELECT chrom_id, l AS \"left\", r AS \"right\", true AS fw, num_reads, CAST(edit_dist AS BIGINT) AS edit_dist FROM b WHERE n = 1"
)
def novel_sites(spark, sf_dir):
    return metrics.novel_sites(metrics.site_support(uses_of(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_align, queries_io, queries_rules  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


#: Score scheme of the queries.
SCORING = Scoring()
