import collections
import random
from dataclasses import replace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seqloom.functions.config import LengthFunction, Options, RepeatOptions
from seqloom.operators import annotation, evaluate, filters, index, intervals, metrics, ordered, pairing, ranking, repeats, simulate
from seqloom.plans import align
from seqloom.streaming import feedback


def told(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def bases(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_running_values_against_a_sweep(spark):
    rng = random.Random(5)
    data = [(rng.choice(["x", None]) if k % 9 == 0 else "x", rng.randrange(60), k, rng.choice([None, rng.randrange(-9, 9)])) for k in range(300)]
    df = ordered.bucketed(spark.createDataFrame(data, "k string, at long, id long, v long"), "at", 12)
    for kind, inclusive in (("sum", True), ("max", True), ("max", False), ("last", True), ("last", False)):
        got = {r.id: r.out for r in ordered.running(df, ["k"], ["at", "id"], "v", "out", kind, inclusive).collect()}
        for key in ("x", None):
            seen = []
            for _, _, i, v in sorted((x for x in data if x[0] == key), key=lambda x: (x[1], x[2])):
                past = [x for x in [*seen, v] if x is not None] if inclusive else [x for x in seen if x is not None]
                assert got[i] == (sum(past) if kind == "sum" else None if not past else max(past) if kind == "max" else past[-1])
                seen.append(v)


def test_one_chromosome_is_many_tasks(spark):
    df = spark.range(4000).selectExpr("1 as c", "id as start", "id + 3 as end")
    sizes = [r["count"] for r in ordered.bucketed(df, "start").groupBy("_bucket").count().collect()]
    assert max(sizes) < 0.1 * 4000
    assert told(intervals.merge(df.where("start % 1000 < 900"), ["c"]), "start", "end", "n") == [(k * 1000, k * 1000 + 902, 900) for k in range(4)]


def test_batched_kernel_is_the_single_one():
    from seqloom.functions.config import Scoring
    from seqloom.operators import kernels

    rng = random.Random(2)
    reads, refs, quals = [], [], []
    for k in range(250):
        ref = "".join(rng.choice("ACGT" if rng.random() < 0.98 else "N") for _ in range(40)) if k % 3 else "AC" * 20
        at, read = rng.randrange(5), []
        for c in ref[at : at + 30]:
            read += [rng.choice("ACGT")] if (r := rng.random()) < 0.04 else [] if r < 0.06 else [c, "A"] if r < 0.08 else [c]
        reads.append("".join(read))
        refs.append(ref)
        quals.append(rng.choice([None, "".join(chr(33 + rng.randrange(41)) for _ in read)]))
    for s in (Scoring(), Scoring(match=2)):
        for fixed in (False, True):
            assert kernels.affine_all(reads, refs, quals, s, fixed_ends=fixed) == [kernels.affine(*x, s, fixed_ends=fixed) for x in zip(reads, refs, quals, strict=True)]


def test_bases_by_tile(spark, monkeypatch):
    s = bases(3, 900)
    ref = spark.createDataFrame([(0, s), (1, s[::-1])], "chrom_id long, seq string")
    rows = [(k % 2, k * 7 - 20, k % 40) for k in range(140)]
    df = spark.createDataFrame(rows, "chrom_id long, start long, n int")
    monkeypatch.setattr(index, "TILE", 164)
    monkeypatch.setattr(index, "OVERLAP", 64)
    for most in (10**6, 0):
        monkeypatch.setattr(index, "MAX_BROADCAST_BASES", most)
        got = [(r.chrom_id, r.start, r.n, r.out) for r in index.bases_at(df, ref, "start", "n", "out", longest=64).collect()]
        assert sorted(got) == sorted((c, a, n, (s if c == 0 else s[::-1])[a : a + n] if a >= 0 and n > 0 else "") for c, a, n in rows)


def test_minimizers_against_brute_force(spark):
    def mixed(x, bits):
        half, mask = bits // 2, (1 << bits) - 1
        for odd in (0x2545F, 0x9E37B):
            x ^= x >> half
            x = x * odd & mask
        return x ^ x >> half

    for k, w, seqs in ((15, 5, [bases(1, 400), bases(2, 16), bases(3, 14), "A" * 90, bases(4, 80) + "N" + bases(5, 120)]), (31, 7, [bases(6, 300)])):
        got = collections.Counter((r.id, r.pos, r.kmer) for r in index.minimizers(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), k, w).collect())
        expected = set()
        for i, s in enumerate(seqs):
            n = len(s) - k + 1
            for at in range(max(n - w, 0) + 1 if n > 0 else 0):
                window = [(mixed(sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(s[p : p + k])), 2 * k), -p) for p in range(at, min(at + w, n)) if "N" not in s[p : p + k]]
                if window:
                    p = -min(window)[1]
                    expected.add((i, p, s[p : p + k]))
        assert got == collections.Counter(expected)


def test_every_single_variant_of_a_long_site_has_its_windows(spark):
    s = bases(8, 400)
    flip = lambda b: "ACGT"[("ACGT".index(b) + 1) % 4]
    v = [(0, f"v{k}", "single", 50 + 6 * k, flip(s[50 + 6 * k])) for k in range(40)]
    rows = index.variant_windows(spark.createDataFrame([(0, s)], "chrom_id long, seq string"), spark.createDataFrame(v, "chrom_id long, id string, type string, pos long, data string"), 12, 4).collect()
    alone = collections.Counter(r.alts[0] for r in rows if len(r.alts) == 1)
    assert alone == {x[1]: 12 for x in v}
    for r in rows:
        assert r.kmer == "".join(flip(c) if f"v{(r.pos + i - 50) // 6}" in r.alts and (r.pos + i - 50) % 6 == 0 else c for i, c in enumerate(s[r.pos : r.pos + 12]))


def test_long_repeats_come_back_whole(spark):
    unit, core = bases(21, 2000), bases(22, 300)
    parts = []
    for k in range(6):
        parts += [bases(100 + k, 150), unit if k % 3 else unit.translate(str.maketrans("ACGT", "TGCA"))[::-1]]
    for k in range(7):
        parts += [bases(200 + k, 90), core]
    text = "".join(parts) + bases(300, 100)
    ref = spark.createDataFrame([("c0", 0, text)], "chrom string, chrom_id long, seq string")
    found = repeats.discover(ref, RepeatOptions(seed_length=50, seed_count=5, min_length=100, count=5)).collect()
    back = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert {min(r.consensus, back(r.consensus)) for r in found} == {min(x, back(x)) for x in (unit, core)}
    assert sorted(r.n for r in found) == [6, 7]
    for r in found:
        for p in r.positions:
            here = text[p.pos : p.pos + len(r.consensus)]
            assert (here if p.fw else back(here)) == r.consensus


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(3)
    make = lambda n: [(k % 2, k, a, a + rng.randrange(90)) for k in range(n) for a in [rng.randrange(900)]]
    left, right = make(60), make(60)
    l = spark.createDataFrame(left, "c int, a int, l_start int, l_end int")
    r = spark.createDataFrame(right, "c int, b int, r_start int, r_end int")
    for reach in (0, 25):
        expected = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] - reach <= y[3] and y[2] <= x[3] + reach)
        assert told(intervals.overlap_join(l, r, ["c"], 64, reach=reach), "a", "b") == expected
    semi = sorted({(x[1],) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]})
    assert told(intervals.overlap_join(l, r, ["c"], 64, "left_semi"), "a") == semi
    assert told(intervals.overlap_join(l, r, ["c"], 64, "left_anti"), "a") == sorted({(x[1],) for x in left} - set(semi))


def test_filters(spark):
    rd = spark.createDataFrame([(0, 0, "A", "1"), (1, 0, "ACGTNNNNNN", "1"), (2, 0, "ACGTACGTAC", "0"), (3, 0, "ACGTACGTAC", None)], "rdid long, mate int, seq string, filter string")
    assert told(filters.filtered(rd, Options(qc_filter=True)), "rdid", "yf") == sorted([(0, "LN"), (1, "NS"), (2, "QC"), (3, None)], key=lambda x: x[0])
    assert filters.sample(rd, 1.0).count() == 4 and filters.sample(rd, 0.0).count() == 0
    s = filters.strands(rd.withColumn("mate", F.when(F.col("rdid") == 3, 2).otherwise(1)), nofw=True)
    assert told(s, "rdid", "fw") == [(0, False), (1, False), (2, False), (3, True)]
    pairs = spark.createDataFrame([(0, 1, "ACGTACGTAC"), (0, 2, "ACGTACGTNN")], "rdid long, mate int, seq string")
    assert told(filters.pair_n_filter(pairs), "mate", "n_ok") == [(1, True), (2, False)]
    assert told(filters.pair_n_filter(pairs, concatenated=True), "mate", "n_ok") == [(1, True), (2, True)]
    v = spark.createDataFrame([("c", "a", "single", 5, 1), ("c", "b", "deletion", 8, 3), ("c", "d", "single", 10, 1), ("c", "e", "single", 12, 1)], "chrom string, id string, type string, pos long, len long")
    assert told(filters.compatible_pairs(v, 10), "id_a", "id_b") == [("a", "b"), ("a", "d"), ("a", "e"), ("b", "e"), ("d", "e")]
    o = spark.createDataFrame([(True, True, False), (False, True, False)], "l boolean, a boolean, b boolean")
    assert [r.v for r in o.select(filters.pair_orientation("fr", F.col("l"), F.col("a"), F.col("b")).alias("v")).collect()] == [True, False]


def test_transcriptome_only(spark):
    rows = [Row(n="in", chrom_id=0, start=5, end=8, junctions=[]), Row(n="out", chrom_id=0, start=5, end=30, junctions=[]), Row(n="known", chrom_id=0, start=5, end=40, junctions=[Row(left=9, right=35)]), Row(n="new", chrom_id=0, start=5, end=40, junctions=[Row(left=9, right=36)])]
    a = spark.createDataFrame(rows, "n string, chrom_id long, start long, end long, junctions array<struct<left:long,right:long>>")
    ex = spark.createDataFrame([(0, 0, 9)], "chrom_id long, left long, right long")
    known = spark.createDataFrame([(0, 9, 35)], "chrom_id long, left long, right long")
    assert told(filters.transcriptome_only(a, ex, known), "n") == [("in",), ("known",)]


def test_annotation(spark):
    ex = spark.createDataFrame([("t1", "c", 1, 10, "+", "g"), ("t1", "c", 14, 20, "+", "g"), ("t1", "c", 40, 50, "+", "g"), ("t2", "c", 45, 60, "+", "g")], "transcript_id string, chrom string, left long, right long, strand string, gene_id string")
    assert told(annotation.splice_sites(ex), "chrom", "left", "right", "strand") == [("c", 19, 39, "+")]
    assert told(annotation.merged_exons(ex), "left", "right") == [(0, 19), (39, 59)]
    v = annotation.vcf_variants(spark.createDataFrame([("r", "c", 9, "TA", ["TAG", "T", "CA", "GG"])], "id string, chrom string, pos long, ref string, alts array<string>"))
    assert told(v, "id2", "pos", "type", "data") == [("r.0", 11, "I", "G"), ("r.1", 10, "D", "1"), ("r.2", 9, "S", "C")]


def test_haplotypes(spark):
    rows = [("c", 10, "S", "A", "v1", 0.01), ("c", 10, "S", "C", "v2", 0.01), ("c", 20, "S", "G", "v3", 0.01), ("c", 200, "S", "G", "v4", 0.5), ("c", 10, "S", "A", "v9", 0.01)]
    df = spark.createDataFrame(rows, "chrom string, pos long, type string, data string, id string, freq double")
    assert told(annotation.haplotypes(df), "left", "right", "alts") == [(10, 10, ["v2"]), (10, 20, ["v1", "v3"]), (200, 200, ["v4"])]
    vs = [{"pos": 10, "type": "S", "data": "A", "freq": 0.0}, {"pos": 12, "type": "S", "data": "A", "freq": 0.2}]
    assert annotation.colour(vs) == [0, 1]
    gt = spark.createDataFrame([("v1", "s1", 0, 1), ("v3", "s1", 0, 1), ("v1", "s2", 1, 1)], "id string, sample string, phase int, allele int")
    one = annotation.genotype_haplotypes(annotation.suffix_ids(annotation.distinct_variants(df)), gt)
    assert told(one, "alts") == [(["v1"],), (["v1", "v3"],)]


def test_variant_windows(spark):
    seq = bases(1, 40)
    ref = spark.createDataFrame([(0, seq)], "chrom_id long, seq string")
    other = next(b for b in "ACGT" if b != seq[20])
    v = spark.createDataFrame([(0, "s", "single", 20, other), (0, "d", "deletion", 24, "2")], "chrom_id long, id string, type string, pos long, data string")
    got = {(r.kmer, tuple(r.alts)) for r in index.variant_windows(ref, v, 8).collect()}
    changed = seq[:20] + other + seq[21:]
    assert {(changed[i : i + 8], ("s",)) for i in range(13, 17)} <= got
    cut = seq[:24] + seq[26:]
    assert (cut[22:30], ("d",)) in got and any(a == ("s", "d") for _, a in got)
    nodes, edges = index.graph(ref, v)
    assert nodes.count() == 41 and edges.count() == 39 + 2 + 1


def test_suffix_ranks(spark):
    seq = bases(2, 50)
    ref = spark.createDataFrame([(0, seq)], "chrom_id long, seq string")
    order = sorted(range(50), key=lambda i: seq[i : i + 12])
    rows = index.ranked_suffixes(ref, 12).collect()
    assert {r.pos: r["rank"] for r in rows} == {i: sum(seq[j : j + 12] < seq[i : i + 12] for j in range(50)) for i in order}


def world(spark, n=3000):
    seqs = [bases(11, n), bases(12, n)]
    return seqs, spark.createDataFrame([(f"c{k}", k, s) for k, s in enumerate(seqs)], "chrom string, chrom_id long, seq string")


def test_align_simulated_pairs(spark):
    seqs, ref = world(spark)
    tr = spark.createDataFrame([(f"t{k}", f"c{k}", s, 0, [Row(start=0, end=len(s))], [], 0.5) for k, s in enumerate(seqs)], "transcript string, chrom string, bases string, offset long, blocks array<struct<start:long,end:long>>, variants array<struct<id:string,type:string,pos:long,data:string>>, share double")
    reads = simulate.simulate(tr, 40, 80, 200, True, 0.01, seed=4).cache()
    assert reads.count() == 80 and simulate.validate(reads, ref).where("not ok").count() == 0
    rd = reads.select("rdid", "mate", "name", "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"), F.lit(None).cast("string").alias("filter"))
    o = Options(kmer=16, spliced=False)
    alns = align.align(rd, ref, index.kmer_index(ref, 16), o).cache()
    out = align.report(rd, alns, ref, o).cache()
    assert out.where("flag & 2 = 2").count() >= 70
    found = out.where("mapped").alias("o").join(reads.alias("r"), (F.col("o.rdid") == F.col("r.rdid")) & (F.col("o.mate") == F.col("r.mate")))
    assert found.where("o.pos = r.pos and o.chrom = r.chrom and o.cigar = r.cigar and o.mapq = 60").count() >= 0.9 * found.count() > 0
    m = metrics.reporting(align.counters(out)).first()
    assert m.npaired == 40 and m.nconcord_uni1 >= 35
    text = metrics.summary_text(m)
    assert "40 reads; of these:" in text and "overall alignment rate" in text
    assert metrics.summary_text(m, new=True).startswith("Summary stats")
    from seqloom.sources.sinks import ordered, sam_records

    lines = [r.value.split("\t") for r in ordered(sam_records(out, o)).collect()]
    assert all(len(x) >= 12 for x in lines) and any("NM:i:0" in "\t".join(x) for x in lines)


def test_align_gaps_and_introns(spark):
    s = bases(21, 400)
    exon1, exon2 = bases(31, 300), bases(32, 300)
    gene = exon1 + "GT" + bases(33, 396) + "AG" + exon2
    ref = spark.createDataFrame([("c0", 0, s), ("c1", 1, gene)], "chrom string, chrom_id long, seq string")
    reads = {"gap": s[50:90] + s[92:132], "ins": s[200:240] + "CA" + s[240:280], "spl": exon1[-40:] + exon2[:40], "far": bases(99, 60)}
    rd = spark.createDataFrame([(k, 0, n, q, "I" * len(q), None) for k, (n, q) in enumerate(reads.items())], "rdid long, mate int, name string, seq string, qual string, filter string")
    o = Options(kmer=14)
    out = {r.qname: r for r in align.report(rd, align.align(rd, ref, index.kmer_index(ref, 14), o), ref, o).collect()}
    assert out["gap"].pos == 50 and "2D" in out["gap"].cigar and out["ins"].cigar.count("2I") == 1
    assert out["spl"].cigar == "40M400N40M" and "XS:A:+" in out["spl"].tags and out["spl"].mapq == 60
    assert out["far"].flag == 4 and "YT:Z:UU" in out["far"].tags


def test_rescue(spark):
    seqs, ref = world(spark, 1000)
    rd = spark.createDataFrame([(0, 1, seqs[0][100:150]), (0, 2, "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[b] for b in reversed(seqs[0][300:350])))], "rdid long, mate int, seq string")
    anchors = spark.createDataFrame([(0, 1, 0, 100, 149, True)], "rdid long, mate int, chrom_id long, pos long, end long, fw boolean")
    hits = pairing.rescue(anchors, rd, index.kmer_index(ref, 12), 12)
    assert (300, 0, False) in {(r.pos, r.rdoff, r.fw) for r in hits.collect()}


def test_ranking(spark):
    a = spark.createDataFrame([(1, 10, 0, 5, 1), (1, 10, 0, 9, 2), (1, 7, 0, 20, 3)], "rdid long, score int, chrom_id long, pos long, tie int")
    assert told(ranking.top_k(a, ["rdid"], 1), "pos") == [(5,)]
    assert told(ranking.top_k(a, ["rdid"], 5), "pos") == [(5,), (9,)]
    assert ranking.top_k(a, ["rdid"], 5, secondary=True).count() == 3 and ranking.random_k(a, ["rdid"], 2).count() == 2
    assert told(ranking.best_and_second(a, ["rdid"]), "best", "second", "n") == [(10, 10, 3)]
    b = [Row(rdid=1, score=9, chrom_id=0, fw=True, n="a", blocks=[Row(read_off=0, ref_off=100, len=50)]), Row(rdid=1, score=8, chrom_id=0, fw=True, n="b", blocks=[Row(read_off=10, ref_off=110, len=50)]), Row(rdid=1, score=7, chrom_id=0, fw=True, n="c", blocks=[Row(read_off=0, ref_off=300, len=50)])]
    df = spark.createDataFrame(b, "rdid long, score int, chrom_id long, fw boolean, n string, blocks array<struct<read_off:int,ref_off:int,len:int>>")
    assert told(ranking.distinct_cells(df, ["rdid"], [F.desc("score")]), "n") == [("a",), ("c",)]
    h = spark.createDataFrame([(1, 1, 0, 5), (1, 1, -3, 9), (1, 2, -9, 1)], "rdid long, rep_id long, score int, pos long")
    assert told(ranking.repeat_choice(h, ["rdid"], 6), "rep_id", "pos") == [(1, 5)]


def test_repeats(spark):
    unit = bases(41, 150)
    text = "".join(bases(50 + k, 120) + unit for k in range(6)) + bases(60, 120)
    ref = spark.createDataFrame([("c0", 0, text)], "chrom string, chrom_id long, seq string")
    o = RepeatOptions(seed_length=50, seed_count=5, min_length=100, count=5, forward_only=True)
    found = repeats.discover(ref, o).cache()
    rows = found.collect()
    assert any(r.consensus in unit and len(r.consensus) >= 100 and r.n == 6 for r in rows) or any(unit in r.consensus for r in rows)
    assert repeats.validate(found, ref).where("mismatches > 0").count() == 0
    assert repeats.chained_seeds(repeats.repeated_seeds(ref, o)).count() == 6
    rep = spark.createDataFrame([(1, "A" * 100, [Row(chrom_id=0, pos=500, fw=True), Row(chrom_id=0, pos=900, fw=False)])], "rep_id long, consensus string, positions array<struct<chrom_id:long,pos:long,fw:boolean>>")
    hits = spark.createDataFrame([(7, 1, 10, 20), (8, 1, 90, 20)], "rdid long, rep_id long, pos long, len long")
    assert told(repeats.expand(hits, rep), "rdid", "pos", "fw") == [(7, 510, True), (7, 970, False)]
    near = spark.createDataFrame([(7, 0, 950)], "rdid long, chrom_id long, pos long")
    assert told(repeats.expand_near(hits, rep, near, 100), "pos") == [(970,)]
    alleles = spark.createDataFrame([(1, 1, 0, 50)], "rep_id long, copy int, pos long, len long")
    assert told(repeats.expand_alleles(hits, rep, alleles), "pos") == [(970,)]
    assert told(repeats.common_places(repeats.expand(hits, rep), repeats.expand(hits, rep), 0), "pos1") == [(510,), (970,)]
    r = spark.createDataFrame([(1, 0, 0, 100), (2, 0, 10, 50), (3, 0, 60, 150), (4, 0, 10, 50)], "id long, chrom_id long, start long, end long")
    assert told(repeats.redundant(r), "id") == [(2,), (4,)]
    assert (1, 2, "contains") in told(repeats.overlaps(r), "a", "b", "kind")
    c = spark.createDataFrame([(1, 0, "ACGT", "ACCT"), (1, 1, "ACCT", "ACCT"), (1, 2, "ACGT", "ACCT")], "rep_id long, allele int, seq string, consensus string")
    vs = repeats.copy_variants(c)
    assert told(vs, "allele", "pos", "ref", "alt") == [(0, 2, "C", "G"), (2, 2, "C", "G")]
    assert told(repeats.allele_haplotypes(vs), "alleles") == [([0, 2],)]
    seeds = spark.createDataFrame([(0, 5, 1, 30), (0, 5, 2, 40), (0, 9, 1, 10)], "chrom_id long, pos long, rep_id long, ext int")
    assert told(repeats.reassign_seeds(seeds), "pos", "rep_id") == [(5, 2)]
    q = spark.createDataFrame([("q", unit)], "id string, seq string")
    target = spark.createDataFrame([("t", text)], "id string, seq string")
    assert repeats.minimizer_hits(q, target, 15, 5, 3).count() == 6
    assert index.is_repeat(q, index.minimizers(target, 15, 5), 15, 5).count() == 1


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", 0, "c", 5, "3M"), ("b", 0, "c", 9, "3M"), ("d", 0, "c", 1, "3M")], "name string, mate int, chrom string, pos long, cigar string")
    found = spark.createDataFrame([("a", 0, "c", 5, "3M", 0), ("b", 0, "c", 8, "3M", 1), ("b", 0, "c", 9, "2M1S", 2)], "name string, mate int, chrom string, pos long, cigar string, nm int")
    r = evaluate.mapping_cost(found, truth).first()
    assert (r.total, r.mapped, r.unique, r.unmapped, r.correct, r.exact, r.nm_0, r.nm_1) == (3, 2, 1, 1, 2, 1, 1, 1)
    j = spark.createDataFrame([("c", k, k + 100) for k in (10, 15, 25, 50)], "chrom string, left long, right long")
    assert told(evaluate.distinct_junctions(j), "left") == [(10,), (25,), (50,)]
    p = evaluate.pair_cost(spark.createDataFrame([("a", "c", 1, 200)], "name string, chrom string, pos1 long, pos2 long"), spark.createDataFrame([("a", "c", 1, 200), ("b", "c", 1, 9)], "name string, chrom string, pos1 long, pos2 long")).first()
    assert (p.total, p.mapped, p.correct, p.concordant, p.unmapped) == (2, 1, 1, 1, 1)


def test_simulator_profiles(spark):
    p = simulate.expression_profile(50)
    assert abs(sum(p) - 1) < 1e-9 and p[0] > p[-1] and simulate.expression_profile(4, True) == [0.25] * 4
    _, ref = world(spark, 300)
    assert told(simulate.dna_profile(ref), "share") == [(0.5,), (0.5,)]


def test_simulated_variants_validate(spark):
    s = bases(71, 600)
    vs = [Row(id="v1", type="single", pos=100, data=next(b for b in "ACGT" if b != s[100])), Row(id="v2", type="deletion", pos=300, data="3"), Row(id="v3", type="insertion", pos=420, data="ACA")]
    tr = spark.createDataFrame([("t", "c", s, 0, [Row(start=0, end=200), Row(start=260, end=600)], vs, 1.0)], "transcript string, chrom string, bases string, offset long, blocks array<struct<start:long,end:long>>, variants array<struct<id:string,type:string,pos:long,data:string>>, share double")
    reads = simulate.simulate(tr, 60, 100, 200, False, 0.02, seed=2).cache()
    ref = spark.createDataFrame([("c", s)], "chrom string, seq string")
    assert simulate.validate(reads, ref).where("not ok").count() == 0
    assert reads.where("cigar like '%N%'").count() > 0 and reads.where("exists(edits, e -> e.snp is not null)").count() > 0


def test_streaming_sites(spark, tmp_path):
    src = tmp_path / "in"
    schema = "rdid long, chrom_id long, left long, right long, fw boolean"
    spark.createDataFrame([(5, 0, 1, 9, True), (3, 0, 1, 9, True), (4, 1, 1, 9, True)], schema).coalesce(1).write.parquet(str(src))
    q = feedback.stream_sites(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("sites").start()
    try:
        q.processAllAvailable()
        assert told(spark.sql("select * from sites"), "chrom_id", "first_rdid", "num_reads") == [(0, 3, 2), (1, 4, 1)]
    finally:
        q.stop()


def test_streaming_windows(spark, tmp_path):
    src = tmp_path / "ev"
    spark.sql("select timestamp'2024-01-01 00:00:01' ts, 'a' event_type union all select timestamp'2024-01-01 00:00:02', 'a' union all select timestamp'2024-01-01 01:00:00', 'b'").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(src))
    q = feedback.windowed_counts(stream, "ts", "1 minute", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("win").start()
    try:
        q.processAllAvailable()
        assert told(spark.sql("select * from win"), "event_type", "n") == [("a", 2), ("b", 1)]
    finally:
        q.stop()


def test_visibility(spark):
    q = spark.createDataFrame([(5000, 0, 100, 50), (1500, 0, 100, 50)], "rdid long, chrom_id long, at long, reach long")
    s = spark.createDataFrame([(0, 120, 200, True, 1000), (0, 900, 950, True, 1)], "chrom_id long, left long, right long, fw boolean, first_rdid long")
    assert told(feedback.visible(q, s, threads=2), "rdid", "left") == [(5000, 120)] and feedback.visible(q, s).count() == 2


def test_session(spark, tmp_path):
    from seqloom.plans.session import Index, NotARepeat, register

    seqs, ref = world(spark, 400)
    rep = spark.createDataFrame([(1, "A" * 50, [Row(chrom_id=0, pos=10, fw=True)])], "rep_id long, consensus string, positions array<struct<chrom_id:long,pos:long,fw:boolean>>")
    index.write_index(str(tmp_path / "ix"), ref, index.kmer_index(ref, 14), repeats=rep)
    ix = Index(spark, str(tmp_path / "ix"), Options(kmer=14, spliced=False))
    assert ix.reference_name(1) == "c1" and ix.reference_name(2) is None and ix.reference_names().count() == 2
    assert told(ix.repeat_expand(1, 5, 10), "pos") == [(15,)]
    with pytest.raises(NotARepeat):
        ix.repeat_expand(9, 0, 1)
    rd = spark.createDataFrame([(0, 0, "r", seqs[1][30:80], "I" * 50, None)], "rdid long, mate int, name string, seq string, qual string, filter string")
    assert told(ix.align(rd), "chrom", "pos") == [("c1", 30)]
    register(spark)
    rep.createOrReplaceTempView("reps")
    assert told(spark.sql("select e.* from reps, lateral repeat_expand(50, positions, 5, 10) e"), "pos") == [(15,)]
    ix.close()
    with pytest.raises(ValueError):
        ix.reference_names()


def test_known_variants_are_free(spark):
    from seqloom.operators import variants

    s = bases(81, 300)
    other = next(b for b in "ACGT" if b != s[100])
    read = s[80:100] + other + s[101:130] + s[131:160]
    ref = spark.createDataFrame([("c0", 0, s)], "chrom string, chrom_id long, seq string")
    rd = spark.createDataFrame([(0, 0, "r", read, "I" * len(read), None)], "rdid long, mate int, name string, seq string, qual string, filter string")
    o = Options(kmer=14, spliced=False)
    alns = align.align(rd, ref, index.kmer_index(ref, 14), o).drop("qual")
    v = spark.createDataFrame([(0, "rs1", "single", 100, other), (0, "rs2", "single", 100, "N"), (0, "rs3", "insertion", 90, "A")], "chrom_id long, id string, type string, pos long, data string")
    before = alns.first()
    marked = variants.apply_known(alns, v)
    after = marked.first()
    assert after.score == before.score + 6
    assert [e.snp for e in after.edits if e.type == "mm"] == ["rs1"]
    out = align.report(rd, marked, ref, o).first()
    assert "Zs:Z:20|S|rs1" in out.tags and "XM:i:0" in out.tags
    h = spark.createDataFrame([("h1", 0, 95, 105, ["rs1"]), ("h2", 0, 200, 210, ["x"])], "hid string, chrom_id long, left long, right long, alts array<string>")
    assert told(variants.haplotypes_over(alns.select("chrom_id", "pos", "end"), h), "hid") == [("h1",)]
    assert variants.edit_score([{"pos": 0, "type": "del", "ref": "AC", "length": 2, "snp": None}, {"pos": 1, "type": "ins", "read": "A", "length": 1, "snp": "x"}]) == -11


def test_align_with_variants_and_junction_uses(spark):
    s = bases(91, 400)
    flip = lambda b: "ACGT"[("ACGT".index(b) + 1) % 4]
    spots = [100, 112, 124, 136, 148]
    read = "".join(flip(b) if 90 + i in spots else b for i, b in enumerate(s[90:160]))
    gene = bases(92, 200) + "GT" + bases(93, 296) + "AG" + bases(94, 200)
    spliced = gene[160:200] + gene[500:540]
    ref = spark.createDataFrame([("c0", 0, s), ("c1", 1, gene)], "chrom string, chrom_id long, seq string")
    v = spark.createDataFrame([(0, f"rs{p}", "single", p, flip(s[p])) for p in spots], "chrom_id long, id string, type string, pos long, data string")
    rd = spark.createDataFrame([(k, 0, f"r{k}", q, "I" * len(q), None) for k, q in enumerate((read, spliced))], "rdid long, mate int, name string, seq string, qual string, filter string")
    ix, o = index.kmer_index(ref, 14), Options(kmer=14)
    assert told(align.align(rd, ref, ix, o), "rdid") == [(1,)]
    found = align.align(rd, ref, ix, o, variants=v).cache()
    assert told(found, "rdid", "pos", "score") == [(0, 90, 0), (1, 160, 0)]
    uses = align.junction_uses(found, ref)
    assert told(uses, "rdid", "left", "right", "left_anchor", "right_anchor", "mismatches", "canonical") == [(1, 199, 500, 40, 40, 0, True)]
    assert told(metrics.site_support(uses), "left", "num_reads") == [(199, 1)]


def test_align_rescues_mates_and_keeps_transcripts(spark):
    flip = lambda b: "ACGT"[("ACGT".index(b) + 1) % 4]
    back = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    s = bases(95, 1200)
    two = "".join(flip(c) if k in (14, 29, 44, 59) else c for k, c in enumerate(s[300:375]))  # no seed of 16 bases is left
    ref = spark.createDataFrame([("c0", 0, s)], "chrom string, chrom_id long, seq string")
    rd = spark.createDataFrame([(1, 1, "r", s[100:160], "I" * 60, None), (1, 2, "r", back(two), "I" * 75, None)], "rdid long, mate int, name string, seq string, qual string, filter string")
    o = Options(kmer=16, spliced=False, scoring=replace(Options().scoring, min_score=LengthFunction("L", 0.0, -0.6)))
    ix = index.kmer_index(ref, 16)
    assert told(align.align(rd, ref, ix, o), "mate", "pos") == [(1, 100)]
    assert told(align.align(rd, ref, ix, replace(o, rescue_kmer=12)), "mate", "pos", "fw", "score") == [(1, 100, True, 0), (2, 300, False, -24)]
    exons = spark.createDataFrame([(0, 90, 170)], "chrom_id long, left long, right long")
    kept = align.align(rd, ref, ix, replace(o, rescue_kmer=12, transcriptome_only=True), exons=exons, known=exons.where("false"))
    assert told(kept, "mate", "pos") == [(1, 100)]


def test_colours_look_at_variants_within_reach_only(monkeypatch):
    seen, end = [], annotation._end
    monkeypatch.setattr(annotation, "_end", lambda v: seen.append(1) or end(v))
    vs = [{"pos": 20 * (k // 2), "type": "S", "data": "AC"[k % 2], "freq": 0.05} for k in range(3000)]
    assert annotation.colour(vs) == [k % 2 for k in range(3000)]
    assert len(seen) < 20 * len(vs)


def test_compatible_pairs_are_one_join(spark):
    rows = spark.createDataFrame([(1, 7, 10, "single", 1), (2, 7, 10, "deletion", 5), (3, 7, 15, "single", 1), (4, 7, 16, "splice", 2), (5, 7, 40, "single", 1)], "id long, chrom long, pos long, type string, len long")
    pairs = filters.compatible_pairs(rows, 20)
    assert sorted((r.id_a, r.id_b) for r in pairs.collect()) == [(1, 3), (1, 4), (2, 4), (3, 4)]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_anchored_hits_are_those_of_all_kmers(spark):
    from seqloom.functions.seq import text_to_bases, window_rows
    from seqloom.operators.index import kmer_index
    from seqloom.plans.align import anchored_hits, seed_hits

    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(9000))
    ref = ref[:4000] + "N" + ref[4001:8000] + ref[:300]
    reads = [ref[100:124], ref[:23], ref[7:31] + ref[50:90], ref[3950:4050], ref[8250:], "", ref[8000:8100] + "N" + ref[20:60], ref[:24], ref, ref[8170:8215], "A" * 40, None]
    stranded = spark.createDataFrame([(i, 0, True, s) for i, s in enumerate(reads)], "rdid long, mate int, fw boolean, s string")
    table = spark.createDataFrame([(0, ref), (1, "A" * 30), (2, "ACG"), (3, None)], "chrom_id long, seq string")
    for k in (24, 15):
        want = sorted(map(tuple, seed_hits(stranded, kmer_index(table, k), k).select("rdid", "mate", "fw", "rdoff", "chrom_id", "pos").collect()))
        assert sorted(map(tuple, anchored_hits(stranded, table, k).select("rdid", "mate", "fw", "rdoff", "chrom_id", "pos").collect())) == want
    # windows at a step are those places only, in blocks as well
    got = sorted(r.pos for r in window_rows(table.where("chrom_id = 0"), ["chrom_id"], "seq", 20, 13).collect())
    assert got == list(range(0, len(ref) - 19, 13))
    text = spark.createDataFrame([("Ab\x00 z\tZ-9\u0130\u212a\u00e9~k",), (None,), ("",)], "text string")
    old = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])
    assert text.where(~text_to_bases("text").eqNullSafe(old)).count() == 0


def test_targeted_reads_are_placed_as_on_all_sequences(spark):
    one, two = bases(31, 700), bases(32, 300)
    ref = spark.createDataFrame([(1, "c1", one + two), (2, "c2", two + one[:200] + "N" + one[201:260]), (3, "c3", "")], "chrom_id long, chrom string, seq string")
    planted = [(k, 0, str(k), s, "I" * len(s), None, t) for k, (s, t) in enumerate([(one[10:70], 1), (one[10:70], 2), (two[5:60] + "ACGTA", 2), (one[400:460], 2), (two[:70], 3), (one[150:205] + "NN" + one[207:240], 2)])]
    reads = spark.createDataFrame(planted, "rdid long, mate int, name string, seq string, qual string, filter string, target long")
    o = Options(kmer=16, spliced=False)
    places = lambda df: told(df, "rdid", "chrom_id", "pos", "fw", "score", "cigar", "md")
    everywhere = align.align(reads.drop("target"), ref, index.kmer_index(ref, 16), o).join(reads.select("rdid", F.col("target").alias("chrom_id")), ["rdid", "chrom_id"])
    want = places(everywhere)
    assert len(want) >= 3
    assert places(align.align(reads, ref, index.kmer_index(ref, 16), o)) == want


def test_equal_candidates_are_aligned_once():
    from seqloom.operators.kernels import _once

    seen = []

    def run(a, b):
        seen.extend(zip(a, b, strict=True))
        return [x + str(y) for x, y in zip(a, b, strict=True)]

    assert _once(run, ["x", "y", "x", "x"], [1, 1, 1, None]) == ["x1", "y1", "x1", "xNone"]
    assert seen == [("x", 1), ("y", 1), ("x", None)]
    assert _once(run, [], []) == []


def test_containment_does_not_grow_with_pairs(spark):
    rng = random.Random(11)
    left = [(k, rng.choice([1, 2, None]), x := rng.choice([None, *range(60)]), None if x is None else x + rng.randrange(-2, 9)) for k in range(150)]
    right = [(rng.choice([1, 2, None]), x := rng.choice([None, *range(60)]), None if x is None else x + rng.randrange(-2, 14)) for _ in range(60)]
    l, r = spark.createDataFrame(left, "a long, c long, l_start long, l_end long"), spark.createDataFrame(right, "c long, r_start long, r_end long")
    want = sorted((a,) for a, c, s, e in left if None not in (c, s) and any(c == d and None not in (x, y) and x <= s and e <= y for d, x, y in right))
    got = intervals.contained(l, r, ["c"])
    assert got.columns == l.columns and told(got, "a") == want
    # ten thousand rows in ten thousand intervals: no step makes rows of pairs
    many = spark.range(10_000).select("id", F.lit(1).alias("c"), F.lit(5).alias("l_start"), F.lit(6).alias("l_end"))
    wide = spark.range(10_000).select(F.lit(1).alias("c"), F.lit(0).alias("r_start"), F.lit(9).alias("r_end"))
    assert intervals.contained(many, wide, ["c"]).count() == 10_000


def test_exons_are_sorted_once(spark):
    rows = [("a", "c", 10, 20, "+"), ("a", "c", 24, 30, "+"), ("a", "c", 12, 15, "+"), ("a", "c", 50, 60, "+"), ("a", "c", 64, 63, "+"), ("b", "d", 1, 2, "-"), ("b", "d", 90, 95, "-")]
    ex = spark.createDataFrame(rows, "transcript_id string, chrom string, left long, right long, strand string")
    merged = annotation.merged_transcript_exons(ex)
    sites = annotation.splice_sites(ex)
    for df in (merged, sites):
        assert df._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    # the exon at 24 starts 9 past the end of the one before it in order, which ends at 15
    assert sorted(map(tuple, merged.select("transcript_id", "left", "right", "chrom", "strand").collect())) == [
        ("a", 10, 15, "c", "+"), ("a", 24, 30, "c", "+"), ("a", 50, 63, "c", "+"), ("b", 1, 2, "d", "-"), ("b", 90, 95, "d", "-")
    ]
    assert sorted(map(tuple, sites.collect())) == [("c", 14, 23, "+"), ("c", 29, 49, "+"), ("d", 1, 89, "-")]
