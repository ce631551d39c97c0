"""Alignments over several introns, known sites, unexplained ends, clipped ends."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seqloom.functions.config import LengthFunction, Options, Scoring
from seqloom.operators import chaining, index, kernels, ranking
from seqloom.plans import align

READ = "rdid long, mate int, name string, seq string, qual string, filter string"


def bases(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def flip(b):
    return "ACGT"[("ACGT".index(b) + 1) % 4]


def back(x):
    return x.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def gene(seed, exons, introns, minus=False):
    """A sequence and the (start, end) of its exons; introns are GT..AG, or CT..AC."""
    out, places = bases(seed, 50), []
    for k, n in enumerate(exons):
        places.append((len(out), len(out) + n))
        out += bases(seed * 100 + k, n)
        if k < len(introns):
            first, last = ("CT", "AC") if minus else ("GT", "AG")
            out += first + bases(seed * 100 + 50 + k, introns[k] - 4) + last
    return out + bases(seed + 7, 50), places


def aligned(spark, seqs, reads, o, **more):
    ref = spark.createDataFrame([(f"c{k}", k, s) for k, s in enumerate(seqs)], "chrom string, chrom_id long, seq string")
    rd = spark.createDataFrame([(k, 0, f"r{k}", s, "I" * len(s), None) for k, s in enumerate(reads)], READ)
    more = {k: spark.createDataFrame(v, "chrom_id long, left long, right long, fw boolean") for k, v in more.items()}
    return align.align(rd, ref, index.kmer_index(ref, o.kmer), o, **more)


def best(alns):
    out = {}
    for r in alns.collect():
        if r.rdid not in out or r.score > out[r.rdid].score:
            out[r.rdid] = r
    return out


def test_reads_over_many_introns(spark):
    s, e = gene(1, [60, 40, 35, 70], [200, 90, 400])
    t, f = gene(2, [60, 40, 60], [150, 300], minus=True)
    three = s[e[0][1] - 30 : e[0][1]] + s[e[1][0] : e[1][1]] + s[e[2][0] : e[2][1]] + s[e[3][0] : e[3][0] + 40]
    minus = t[f[0][1] - 40 : f[0][1]] + t[f[1][0] : f[1][1]] + t[f[2][0] : f[2][0] + 40]
    wrong = three[:50] + flip(three[50]) + three[51:]
    gapped = three[:125] + three[126:]
    got = best(aligned(spark, [s, t], [three, minus, back(three), wrong, gapped, s[60:160]], Options(kmer=14, scoring=replace(Scoring(), min_score=LengthFunction("L", 0.0, -0.4)))))
    want = "30M200N40M90N35M400N40M"
    assert (got[0].pos, got[0].cigar, got[0].score, got[0].splice_strand) == (e[0][1] - 30, want, 0, "+")
    assert (got[1].pos, got[1].cigar, got[1].score, got[1].splice_strand) == (f[0][1] - 40, "40M150N40M300N40M", 0, "-")
    assert (got[2].fw, got[2].cigar, got[2].score) == (False, want, 0)
    assert (got[3].cigar, got[3].score, got[3].md) == (want, -6, f"50{three[50]}94")
    assert (got[4].score, got[4].cigar.count("D"), got[4].cigar.count("N")) == (-8, 1, 3)
    assert got[5].cigar == "100M"


def test_introns_of_two_strands_are_no_alignment(spark):
    s = bases(1, 60) + "GT" + bases(2, 96) + "AG" + bases(3, 40) + "CT" + bases(4, 96) + "AC" + bases(5, 60)
    read = s[30:60] + s[160:200] + s[300:330]
    assert 0 not in best(aligned(spark, [s], [read], Options(kmer=14)))


def brute_place(read, stretches, s):
    """All places of all joints, both strands."""
    best, n = None, len(read)
    pen = 6

    def walk(i, k, cost, cuts, strand):
        nonlocal best
        _, b, *_ = stretches[i]
        if i == len(stretches) - 1:
            total = cost + sum(pen for x in range(k, n) if read[x] != b[2 + x])
            if best is None or total < best[0]:
                best = (total, tuple(cuts), strand)
            return
        gap, (_, nb, *_) = stretches[i + 1][0] - stretches[i][0], stretches[i + 1]
        lost = max(0, -gap)
        for cut in range(k, n + 1):
            if stretches[i][2] < cut and cut + lost < stretches[i + 1][3]:
                own = sum(pen for x in range(k, cut) if read[x] != b[2 + x])
                if gap >= s.min_intron:
                    motif = kernels.MOTIFS.get((b[cut + 2 : cut + 4], nb[cut : cut + 2]))
                    own += 0 if motif == (strand, True) else s.noncanonical
                else:
                    own += 5 + 3 * abs(gap)
                walk(i + 1, cut + lost, cost + own, [*cuts, cut], strand)

    for strand in "+-":
        walk(0, 0, 0, [], strand)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_joints_are_placed_at_the_least_cost(seed):
    rng, s = random.Random(seed), Scoring(min_intron=20)
    n, m = 24, rng.choice([2, 3])
    read = "".join(rng.choice("AG" if seed % 3 else "ACGT") for _ in range(n))
    stretches, diagonal = [], 100
    for i in range(m):
        b = "".join(c if rng.random() < 0.8 else rng.choice("ACGT") for c in rng.choice(["GT", "AG"]) + read + rng.choice(["GT", "AG"]))
        stretches.append((diagonal, b, i * n // m, (i + 1) * n // m + 1, None, None))
        diagonal += rng.choice([30, 60, 3, -3])
    want = brute_place(read, stretches, s)
    got = kernels and chaining.place_joints(read, None, stretches, s)
    assert (got is None) == (want is None)
    if want:
        assert -got["score"] == want[0]
        spelled = sum(kernels.edit_cost(e, np.full(n, 6), s) for e in got["edits"])
        assert spelled <= want[0]


def test_chains_of_hits():
    s = Scoring()
    at, place, size = np.array([0, 10, 30, 30, 60]), np.array([100, 110, 1130, 5_000_000, 2160]), np.array([20, 20, 30, 40, 30])
    found = chaining.best_chains(at, place, size, s, 3)
    assert found[0] == [0, 1, 2, 4]
    assert chaining.best_chains(at[:2], place[:2], size[:2], s, 3) == []  # one diagonal


def test_known_sites_place_short_anchors(spark):
    s, e = gene(3, [80, 60], [200])
    read = s[e[0][1] - 50 : e[0][1]] + s[e[1][0] : e[1][0] + 7]
    other = s[e[0][1] - 9 : e[0][1]] + s[e[1][0] : e[1][0] + 48]
    o = Options(kmer=16)
    site = [(0, e[0][1] - 1, e[1][0], True)]
    assert not [r for r in aligned(spark, [s], [read, other], o).collect() if "N" in r.cigar]
    got = best(aligned(spark, [s], [read, other], o, sites=site))
    assert (got[0].cigar, got[0].score, got[0].splice_strand) == ("50M200N7M", 0, "+") and got[1].cigar == "9M200N48M"
    six = s[e[0][1] - 50 : e[0][1]] + s[e[1][0] : e[1][0] + 6]
    assert not [r for r in aligned(spark, [s], [six], o, sites=site).collect() if "N" in r.cigar]
    # a known site needs no motif
    u = bases(8, 400)
    assert not [r for r in aligned(spark, [u], [u[60:100] + u[250:290]], o).collect() if "N" in r.cigar and r.score == 0]
    got = best(aligned(spark, [u], [u[60:100] + u[250:290]], o, sites=[(0, 99, 250, True)]))
    assert got[0].cigar == "40M150N40M" and got[0].score == 0


def test_second_pass_knows_the_sites_of_the_first(spark):
    s, e = gene(4, [80, 60], [200])
    whole = s[e[0][1] - 40 : e[0][1]] + s[e[1][0] : e[1][0] + 40]
    short = s[e[0][1] - 50 : e[0][1]] + s[e[1][0] : e[1][0] + 8]
    ref = spark.createDataFrame([("c0", 0, s)], "chrom string, chrom_id long, seq string")
    rd = spark.createDataFrame([(k, 0, f"r{k}", x, "I" * len(x), None) for k, x in enumerate([whole, short])], READ)
    o, ix = Options(kmer=16), index.kmer_index(ref, 16)
    assert 1 not in {r.rdid for r in align.align(rd, ref, ix, o).where("cigar like '%N%'").collect()}
    got = best(align.align_twice(rd, ref, ix, o))
    assert got[0].cigar == "40M200N40M" and got[1].cigar == "50M200N8M"


def test_unexplained_ends(spark):
    s, e = gene(5, [80, 60], [200])
    tail = list(s[e[1][0] : e[1][0] + 20])
    tail[10] = flip(tail[10])
    head = list(s[e[0][1] - 20 : e[0][1]])
    head[9] = flip(head[9])
    reads = [s[e[0][1] - 40 : e[0][1]] + "".join(tail), "".join(head) + s[e[1][0] : e[1][0] + 40]]
    o = Options(kmer=16)
    assert not [r for r in aligned(spark, [s], reads, o).collect() if "N" in r.cigar]
    got = best(aligned(spark, [s], reads, replace(o, end_kmer=8)))
    assert (got[0].cigar, got[0].score) == ("40M200N20M", -6) and (got[1].cigar, got[1].score) == ("20M200N40M", -6)


def test_clipped_ends_in_the_plan(spark):
    s = bases(6, 400)
    read = "".join(map(flip, s[97:100])) + s[100:160] + "".join(map(flip, s[160:163]))
    got = best(aligned(spark, [s], [read], Options(kmer=16, spliced=False, soft_clip=True)))[0]
    assert (got.pos, got.end, got.cigar, got.md, got.score) == (100, 159, "3S60M3S", "60", -12) and not got.edits
    got = best(aligned(spark, [s], [read], Options(kmer=16, spliced=False, local=True)))[0]
    assert (got.pos, got.cigar, got.score) == (100, "3S60M3S", 120)
    g, e = gene(9, [60, 60], [200])
    spliced = "".join(map(flip, g[e[0][1] - 32 : e[0][1] - 30])) + g[e[0][1] - 30 : e[0][1]] + g[e[1][0] : e[1][0] + 30]
    got = best(aligned(spark, [g], [spliced], Options(kmer=16, soft_clip=True)))[0]
    assert (got.pos, got.cigar, got.score) == (e[0][1] - 30, "2S30M200N30M", -4)


def test_template_length_counts_clipped_bases(spark):
    s = bases(11, 600)
    one = "".join(map(flip, s[98:100])) + s[100:150]
    two = back(s[250:300] + "".join(map(flip, s[300:303])))
    ref = spark.createDataFrame([("c0", 0, s)], "chrom string, chrom_id long, seq string")
    rd = spark.createDataFrame([(0, 1, "r", one, "I" * 52, None), (0, 2, "r", two, "I" * 53, None)], READ)
    o = Options(kmer=16, spliced=False, soft_clip=True)
    got = {r.mate: r for r in align.report(rd, align.align(rd, ref, index.kmer_index(ref, 16), o), ref, o).collect()}
    assert (got[1].cigar, got[2].cigar, got[1].tlen, got[2].tlen) == ("2S50M", "50M3S", 205, -205)
    assert got[1].category == "concordant" and "MD:Z:50" in got[1].tags


def brute_clip(read, ref, s):
    n = len(read)
    cost = lambda i, j: 2 * i + 2 * (n - j) + sum(6 for k in range(i, j) if read[k] != ref[k])
    return min(cost(i, j) for i in range(n) for j in range(i + 1, n + 1))


@pytest.mark.parametrize("seed", range(20))
def test_clipped_diagonal(seed):
    rng = random.Random(seed)
    ref = "".join(rng.choice("ACGT") for _ in range(30))
    read = "".join(c if rng.random() < 0.7 else flip(c) for c in ref)
    score, start, left, right, edits = kernels.clip_diagonal(read, ref, None)
    assert -score == brute_clip(read, ref, Scoring()) and start == left
    inside = [k for k in range(left, 30 - right) if read[k] != ref[k]]
    assert [e["pos"] + left for e in edits] == inside and -score == 2 * (left + right) + 6 * len(inside)
    whole = [{"pos": k, "type": "mm", "ref": ref[k], "read": read[k], "length": 1, "snp": None} for k in range(30) if read[k] != ref[k]]
    assert kernels.clip_ends(read, None, -6 * len(whole), 0, whole)[0] == score or len(whole) == 30


def test_clip_ends_keeps_introns():
    edits = [{"pos": 1, "type": "mm", "ref": "A", "read": "C", "length": 1, "snp": None}, {"pos": 3, "type": "ins", "ref": "", "read": "GG", "length": 2, "snp": None}, {"pos": 10, "type": "spl", "ref": "", "read": "", "length": 50, "snp": None}, {"pos": 18, "type": "del", "ref": "ACG", "read": "", "length": 3, "snp": None}]
    score, start, left, right, kept = kernels.clip_ends("C" * 20, None, -6 - 11 - 14, 100, edits)
    assert (score, start, left, right) == (-10 - 4, 103, 5, 2) and [(e["type"], e["pos"]) for e in kept] == [("spl", 5)]


def test_composed_edits():
    from seqloom.functions.cigar import build_cigar, compose, reference_side

    rng = random.Random(12)
    for _ in range(300):
        consensus = bases(rng.randrange(10**6), 60)
        # random edits of the consensus on the copy, far enough apart
        copy_edits, copy, at = [], "", 0
        while at < 60:
            kind = rng.choice(["", "", "", "", "", "", "", "mm", "ins", "del"])
            if kind == "mm":
                copy_edits.append({"pos": at, "type": "mm", "ref": flip(consensus[at]), "read": consensus[at], "length": 1, "snp": None})
                copy, at = copy + flip(consensus[at]), at + 1
            elif kind == "ins" and at + 2 < 60:
                copy_edits.append({"pos": at, "type": "ins", "ref": "", "read": consensus[at : at + 2], "length": 2, "snp": None})
                copy, at = copy + consensus[at + 2], at + 3
            elif kind == "del" and at:
                copy_edits.append({"pos": at, "type": "del", "ref": "CA", "read": "", "length": 2, "snp": None})
                copy, at = copy + "CA" + consensus[at], at + 1
            else:
                copy, at = copy + consensus[at], at + 1
        pos = rng.randrange(5, 15)
        read, edits, k = "", [], pos
        while k < 50:
            kind = rng.choice(["", "", "", "", "", "", "", "mm", "ins", "del"])
            if kind == "mm":
                edits.append({"pos": len(read), "type": "mm", "ref": consensus[k], "read": flip(consensus[k]), "length": 1, "snp": None})
                read, k = read + flip(consensus[k]), k + 1
            elif kind == "ins" and read:
                edits.append({"pos": len(read), "type": "ins", "ref": "", "read": "GG", "length": 2, "snp": None})
                read, k = read + "GG" + consensus[k], k + 1
            elif kind == "del" and read:
                edits.append({"pos": len(read), "type": "del", "ref": consensus[k : k + 2], "read": "", "length": 2, "snp": None})
                read, k = read + consensus[k + 2], k + 3
            else:
                read, k = read + consensus[k], k + 1
        start, found = compose(consensus, read, pos, edits, copy_edits)
        spelled = reference_side(read, found)
        assert copy[start : start + len(spelled)] == spelled
        covered = sum(e["length"] for e in found if e["type"] == "ins")
        assert build_cigar(len(read), found) and covered <= len(read)


def test_composed_records_on_both_strands(spark):
    from seqloom.functions.cigar import build_md  # noqa: F401
    from seqloom.operators import evaluate

    consensus = bases(13, 80)
    copy = consensus[:20] + flip(consensus[20]) + consensus[21:40] + consensus[42:]
    edits = [{"pos": 20, "type": "mm", "ref": flip(consensus[20]), "read": consensus[20], "length": 1, "snp": None}, {"pos": 40, "type": "ins", "ref": "", "read": consensus[40:42], "length": 2, "snp": None}]
    s = bases(14, 100) + copy + bases(15, 50) + back(copy) + bases(16, 50)
    kind = "array<struct<pos:int,type:string,ref:string,read:string,length:int,snp:string>>"
    copies = spark.createDataFrame([(1, consensus, 0, 100, 78, True, edits), (1, consensus, 0, 228, 78, False, edits)], f"rep_id long, consensus string, chrom_id long, start long, span int, fw boolean, copy_edits {kind}")
    records = spark.createDataFrame([(1, "r", 10, consensus[10:60], [])], f"rep_id long, name string, pos long, seq string, edits {kind}")
    got = {r.fw: r for r in evaluate.composed_records(records, copies).collect()}
    assert (got[True].pos, got[True].cigar) == (110, "30M2I18M") and (got[False].cigar, got[False].seq) == ("18M2I30M", back(consensus[10:60]))
    from seqloom.functions.cigar import reference_side

    for r in got.values():
        spelled = reference_side(r.seq, [e.asDict() for e in r.edits])
        assert s[r.pos : r.pos + len(spelled)] == spelled


def test_typed_alleles_of_many(spark, monkeypatch):
    from seqloom.operators import metrics

    rng = random.Random(17)
    of = {a: sorted(rng.sample(range(60), 12)) for a in range(400)}
    shown = []
    for k in range(300):
        a = of[37 if k % 2 else 211]
        shown += [(k, v) for v in rng.sample(a, 3)]
    shown += [(k, 1000) for k in range(0, 300, 29)]
    variants = spark.createDataFrame(shown, "aln_id long, variant long")
    alleles = spark.createDataFrame([(a, v) for a, vs in of.items() for v in vs], "allele long, variant long")
    monkeypatch.setattr(metrics, "MAX_ALLELES", 1000)
    whole = metrics.typed_pair(variants, alleles).first()
    monkeypatch.setattr(metrics, "MAX_ALLELES", 20)
    pruned = metrics.typed_pair(variants, alleles).first()
    assert whole == pruned and {whole.allele_a, whole.allele_b} == {37, 211}
    shares = {r.allele: r.share for r in metrics.allele_weights(variants, alleles).collect()}
    assert sorted(shares, key=shares.get)[-2:] in ([37, 211], [211, 37]) and sum(shares.values()) <= 1 + 1e-6


def test_reads_with_common_seeds(spark):
    """More copies than seeds may have places: reads inside a repeat are found, on copies that tie, and so are those over its end."""
    unit = bases(18, 150)
    s = "".join(bases(200 + k, 37) + (unit if k % 3 else unit[:70] + flip(unit[70]) + unit[71:]) for k in range(30)) + bases(19, 40)
    o = Options(kmer=16, spliced=False, max_hits=6, max_seeds=5)
    reads = [unit[20:80], unit[90:140], s[37 + 120 : 37 + 180]]
    alns = aligned(spark, [s], reads, o).collect()
    places = {k: [p for p in range(len(s)) if s.startswith(x, p)] for k, x in enumerate(reads)}
    for k in range(3):
        perfect = [r.pos for r in alns if r.rdid == k and r.score == 0]
        assert set(perfect) <= set(places[k]) and len(perfect) >= min(5, len(places[k]))
    again = aligned(spark, [s], reads, replace(o, max_hits=None, max_seeds=100)).collect()
    assert {r.pos for r in again if r.rdid == 2 and r.score == 0} == set(places[2])


def test_repeats_grow_over_gaps_and_changed_bases(spark):
    from seqloom.functions.config import RepeatOptions
    from seqloom.operators import repeats

    unit = bases(31, 400)
    kinds = [unit, unit, unit[:150] + unit[151:], unit[:220] + "ACG" + unit[220:], unit[:300] + flip(unit[300]) + unit[301:], unit, unit[:99] + flip(unit[99]) + unit[100:250] + unit[252:]]
    parts, places = "", []
    for k, x in enumerate(kinds):
        parts += bases(400 + k, 60)
        places.append((len(parts), len(x), True))
        parts += x
    parts += bases(420, 60)
    places.append((len(parts), 400, False))
    parts += back(unit) + bases(421, 60)
    ref = spark.createDataFrame([("c0", 0, parts)], "chrom string, chrom_id long, seq string")
    o = RepeatOptions(seed_length=50, seed_count=5, min_length=100, count=5)
    found = [r for r in repeats.discover(ref, o).collect() if unit in (r.consensus, back(r.consensus))]
    assert len(found) == 1 and found[0].n == 8
    turned = found[0].consensus != unit
    assert sorted((p.pos, s, p.fw != turned) for p, s in zip(found[0].positions, found[0].spans, strict=True)) == sorted(places)
    exact = repeats.discover(ref, RepeatOptions(seed_length=50, seed_count=5, min_length=100, count=5, max_edit=0)).collect()
    assert not [r for r in exact if r.n == 8 and len(r.consensus) == 400]


def test_similar_repeats_become_one(spark):
    from seqloom.operators import repeats

    rng = random.Random(33)
    unit = bases(32, 300)
    worn = "".join(flip(c) if rng.random() < 0.03 else c for c in unit[20:260])
    other = bases(34, 200)
    kind = "rep_id long, consensus string, positions array<struct<chrom_id:long,pos:long,fw:boolean>>"
    at = lambda *ps: [Row(chrom_id=0, pos=p, fw=f) for p, f in ps]
    found = spark.createDataFrame([(1, unit, at((1000, True), (2000, False))), (2, worn, at((1020, True), (5000, True), (6000, False))), (3, back(worn)[:200], at((8000, True),)), (4, other, at((9000, True),))], kind)
    got = {r.rep_id: r for r in repeats.merge_similar(found).collect()}
    assert set(got) == {1, 4} and got[4].n == 1
    # worn is unit[20:260]: copies begin 20 bases before it, or 40 bases before its turned copy; the third is the end of worn, turned
    assert [(p.pos, p.fw) for p in got[1].positions] == [(1000, True), (2000, False), (4980, True), (5960, False), (7960, False)]
    assert {r.member for r in repeats.similar_repeats(found.where("rep_id in (1, 4)")).collect()} == set()


def test_chains_without_a_stretch_by_chance():
    """A hit of eight bases between two exons covers more bases than the joint costs, and hides the chain of the exons alone."""
    hits = [np.array(x, np.int64) for x in ([0, 45, 51], [24, 79, 157], [45, 8, 9])]
    assert chaining.best_chains(*hits, Scoring(), 10) == [[0, 1, 2], [0, 2]]
    assert chaining.best_chains(*hits, Scoring(), 1) == [[0, 1, 2]]


def test_introns_that_gain_nothing(spark):
    rows = [(1, 0, True, 5, 10, 99, -6, 1), (1, 0, True, 5, 10, 300, -6, 2), (1, 0, True, 5, 10, 200, 0, 2), (1, 0, True, 5, 40, 300, -6, 0), (2, 0, True, 5, 10, 300, -6, 2)]
    alns = spark.createDataFrame(rows, "rdid long, mate int, fw boolean, chrom_id long, pos long, end long, score int, introns int")
    got = ranking.needed_introns(alns, ["rdid", "mate"], F.col("introns"))
    assert sorted((r.rdid, r.end, r.introns) for r in got.collect()) == [(1, 99, 1), (1, 200, 2), (1, 300, 0), (2, 300, 2)]
