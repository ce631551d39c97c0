import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import cigar, sam, scoring, seq
from seqloom.functions.config import LengthFunction, Options, Scoring
from seqloom.operators import kernels, ranking


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sequence_functions(spark):
    v = lambda c: value(spark, c)
    assert v(seq.reverse_complement(F.lit("AACGTN"))) == "NACGTT"
    assert [v(seq.base_code(F.lit(x))) for x in "ACGTN-"] == [0, 1, 2, 3, 4, 4]
    assert v(seq.trim(F.lit("ABCDEFG"), 2, 1)) == "CDEF" and v(seq.trim(F.lit("AB"), 2, 1)) == ""
    assert v(seq.kmer_int(F.lit("ACGT"))) == 27 and v(seq.kmer_int(F.lit("ACGN"))) is None
    assert v(seq.iupac_mask(F.lit("R"))) == 5
    assert v(seq.clean_name(F.lit("r1/1 rest"), pair=True)) == "r1"
    assert v(seq.collapse_cg(F.lit("ACGCGT"))) == "ATGTGT"
    assert [tuple(x) for x in v(seq.windows(F.lit("ABCDE"), 3))] == [(0, "ABC"), (1, "BCD"), (2, "CDE")]
    assert v(seq.windows(F.lit("AB"), 3)) == []
    assert v(seq.chrom_name(F.lit("chr1"), remove=True)) == "1"
    with pytest.raises(ValueError):
        seq.chrom_name("x", True, True)


def test_window_rows_span_blocks(spark):
    text = "".join(random.Random(1).choice("ACGT") for _ in range(9500))
    got = {(r.pos, r.kmer) for r in seq.window_rows(spark.createDataFrame([(1, text)], "id int, s string"), ["id"], "s", 7).collect()}
    assert got == {(i, text[i : i + 7]) for i in range(9494)}


def test_minimizer_hash_is_invertible(spark):
    n = spark.range(1 << 12).select(seq.minimizer_hash(F.col("id"), 12).alias("h")).distinct().count()
    assert n == 1 << 12


def test_length_functions():
    assert LengthFunction.parse("L,0,-0.2").value(100) == -20
    assert LengthFunction.parse("C,5").value(9) == 5
    assert int(LengthFunction.parse("G,-8,1").value(20)) == -5
    for bad in ("X,1", "L", "L,1", "C,1,2,3,4,5"):
        with pytest.raises(ValueError):
            LengthFunction.parse(bad)


def test_presets():
    assert Options().seeds == 10
    assert Options().preset("sensitive").khits == 10
    assert Options().preset("very-sensitive").scoring.min_score.slope == -1.0
    with pytest.raises(ValueError):
        Options().preset("none")


def test_penalties(spark):
    v = lambda c: value(spark, c)
    assert [v(scoring.mismatch_penalty(F.lit(q))) for q in (0, 10, 39, 40, 60)] == [2, 3, 5, 6, 6]
    assert v(scoring.gap_penalty(F.lit(2))) == 11 and v(scoring.gap_penalty(F.lit(0))) == 0
    # gaps: 5 + 3 for the first base, 3 for each further one
    assert [v(scoring.max_gaps(F.lit(-s), F.lit(10))) for s in (7, 8, 10, 11, 20)] == [0, 1, 1, 2, 5]
    assert v(scoring.max_intron(F.lit(6))) == 0 and v(scoring.max_intron(F.lit(7))) == 1 << 13
    assert v(scoring.max_intron_noncanonical(F.lit(14))) == 1 << 18
    assert v(scoring.noncanonical_splice_penalty(F.lit(100), F.lit(20))) == 12
    assert v(scoring.required_probability(F.lit(5000))) == 0.88
    assert v(scoring.decode_quality(F.lit("I"))) == 40 and v(scoring.decode_quality(F.lit("h"), "phred64")) == 40
    assert v(scoring.base_score(F.lit("A"), F.lit("N"), F.lit(40))) == -1
    site = lambda a, b: v(scoring.site_probability(F.lit(a), F.lit(b)))
    assert site("CAGGTAAGT", "TTTTTTTTTTTCAGG"[:15]) > 0.99 and site("CAGCCAAGT", "AAAAAAAAAAAACCC") < 0.01
    assert site("CAGGTAAGN", "T" * 15) is None and site("CAG", "T" * 15) is None
    assert v(scoring.ungapped_score(F.lit("ACGN"), F.lit("ACTA"))) == -7


def test_composite_score_order(spark):
    c = lambda *x: value(spark, scoring.composite_score(*map(F.lit, x)))
    assert c(-1, 0, 0, 0, 0) > c(-2, 1, 2, 0, 0) > c(-2, 0, 2, 0, 0) > c(-2, 0, 0, 0, 0) > c(-2, 0, 0, 300, 0) > c(-2, 0, 0, 300, 5)


def test_mapq(spark):
    q = lambda b, s, e=None: value(spark, ranking.mapq(F.lit(b), F.lit(s).cast("int"), F.lit(0), F.lit(-20), None if e is None else F.lit(e)))
    assert q(-3, None) == 60 and q(-3, -5) == 60
    assert q(0, 0) == 1 and q(-10, -10) == 0
    assert q(0, None, True) == 42 and q(0, -20, True) == 39 and q(-2, -20, True) == 33
    b = lambda x, s: value(spark, ranking.mapq_binned(F.lit(x), F.lit(s).cast("int"), F.lit(0), F.lit(-20)))
    assert b(-3, None) == 255 and b(0, 0) == 2 and b(-2, -4) == 14


def test_flags(spark):
    f = lambda **k: value(spark, sam.flag(**{n: F.lit(x) for n, x in k.items()}))
    assert f(paired=True, proper=True, mapped=True, mate_mapped=True, forward=True, mate_forward=False, mate=1, secondary=False) == 99
    assert f(paired=True, proper=True, mapped=True, mate_mapped=True, forward=False, mate_forward=True, mate=2, secondary=False) == 147
    assert f(paired=False, proper=False, mapped=False, mate_mapped=False, forward=True, mate_forward=True, mate=0, secondary=False) == 4


def test_cigar_columns(spark):
    v = lambda c: value(spark, c)
    x = F.lit("5S10M2I3D100N20M3S")
    assert v(cigar.reference_span(x)) == 133 and v(cigar.read_span(x)) == 40
    assert v(cigar.clip(x)) == 5 and v(cigar.clip(x, False)) == 3
    assert [tuple(j) for j in v(cigar.cigar_junctions(F.lit(100), x))] == [(112, 213)]
    assert v(cigar.cigar_junctions(F.lit(100), F.lit("*"))) == []


def mutate(rng, ref, n):
    """A read from ref with edits, and the edits."""
    start = rng.randrange(5, len(ref) - n - 10)
    read, edits, at = "", [], start
    while len(read) < n:
        r = rng.random()
        if 5 < len(read) < n - 6 and r < 0.03:
            k = rng.randint(1, 3)
            edits.append({"pos": len(read), "type": "del", "ref": ref[at : at + k], "read": "", "length": k, "snp": None})
            at += k
        elif 5 < len(read) < n - 6 and r < 0.06:
            new = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 3)))
            edits.append({"pos": len(read), "type": "ins", "ref": "", "read": new, "length": len(new), "snp": None})
            read += new
        elif r < 0.1:
            base = rng.choice([b for b in "ACGT" if b != ref[at]])
            edits.append({"pos": len(read), "type": "mm", "ref": ref[at], "read": base, "length": 1, "snp": None})
            read, at = read + base, at + 1
        else:
            read, at = read + ref[at], at + 1
    return start, at, read, edits


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_edits_round_trip(seed):
    rng = random.Random(seed)
    ref = "".join(rng.choice("ACGT") for _ in range(120))
    start, end, read, edits = mutate(rng, ref, 60)
    assert cigar.reference_side(read, edits) == ref[start:end]
    slid = cigar.left_align(read, edits)
    assert cigar.reference_side(read, slid) == ref[start:end]
    assert cigar.invert(cigar.invert(edits, len(read)), len(read)) == edits


def test_md_and_cigar():
    mm = {"type": "mm", "ref": "A", "read": "C", "length": 1, "snp": None}
    edits = [mm | {"pos": 0}, {"pos": 4, "type": "del", "ref": "GT", "read": "", "length": 2, "snp": None}, mm | {"pos": 4}]
    assert cigar.build_cigar(8, edits) == "4M2D4M"
    assert cigar.build_md(8, edits) == "0A3^GT0A3"
    assert cigar.edits_of("C" * 8, "4M2D4M", "0A3^GT0A3") == edits
    assert cigar.build_cigar(4, [], 2, 1) == "2S4M1S" and cigar.build_md(4, []) == "4"


def test_left_alignment_of_a_homopolymer():
    edits = [{"pos": 5, "type": "del", "ref": "A", "read": "", "length": 1, "snp": None}]
    assert cigar.left_align("CGAAAT", [dict(edits[0]) | {"ref": "C"}])[0]["pos"] == 5
    assert cigar.left_align("CGAAAT", [edits[0] | {"pos": 4}])[0]["pos"] == 2
    assert cigar.left_align("CGAAAT", [edits[0] | {"pos": 4, "snp": "rs1"}])[0]["pos"] == 4


def test_left_alignment_of_a_batch(monkeypatch):
    """Whole batches get what each row gets, without a call for each row; letters of several bytes go row by row."""
    import pyarrow as pa

    rng, rows = random.Random(3), []
    for _ in range(3000):
        read, edits = "".join(rng.choice("AC") for _ in range(rng.randint(1, 12))), []
        for _ in range(rng.randint(0, 4)):
            kind, at, gap = rng.choice(["mm", "del", "ins", "spl"]), rng.randint(0, len(read)), "".join(rng.choice("AC") for _ in range(rng.randint(1, 3)))
            edits.append({"pos": at, "type": kind, "ref": gap if kind == "del" else "", "read": gap if kind == "ins" else "", "length": len(gap), "snp": rng.choice([None, None, "", "rs"])})
        rows.append((read, edits if rng.random() > 0.05 else None))
    fields = [(n, pa.int32() if n in ("pos", "length") else pa.string()) for n in cigar.EDIT_TYPE.names]
    batch = lambda rows: (pa.array([r for r, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.list_(pa.struct(fields))))
    want, plain = [cigar.left_align(r, e or []) for r, e in rows], cigar.left_align
    other = [("CÄÄÄT", [{"pos": 4, "type": "del", "ref": "Ä", "read": "", "length": 1, "snp": None}])]
    assert cigar.left_aligned.func(*batch(other)).to_pylist() == [plain(*other[0])]
    monkeypatch.delattr(cigar, "left_align")
    assert cigar.left_aligned.func(*batch(rows)).to_pylist() == want
    sliced = [a[100:900] for a in batch(rows)]
    assert cigar.left_aligned.func(*sliced).to_pylist() == want[100:900]
    assert cigar.left_aligned.func(*batch(rows[:0])).to_pylist() == []


def brute_affine(read, ref, s):
    """Score of the best end-to-end placement by the textbook recursion."""
    low = -10**9
    n, m = len(read), len(ref)
    h = [[low] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    for j in range(m + 1):
        h[0][j] = 0
    for i in range(1, n + 1):
        for j in range(m + 1):
            e[i][j] = max(e[i - 1][j], h[i - 1][j] - s.ref_gap_open) - s.ref_gap_extend
            if j:
                f[i][j] = max(f[i][j - 1], h[i][j - 1] - s.read_gap_open) - s.read_gap_extend
            d = h[i - 1][j - 1] + (0 if read[i - 1] == ref[j - 1] else -s.mismatch_max) if j else low
            h[i][j] = max(d, e[i][j], f[i][j])
    return max(h[n])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_affine_kernel(seed):
    rng = random.Random(seed)
    s = Scoring(ignore_quals=True)
    ref = "".join(rng.choice("ACGT") for _ in range(60))
    _, _, read, _ = mutate(rng, ref, 30)
    score, start, left, edits = kernels.affine(read, ref, None, s)
    assert score == brute_affine(read, ref, s)
    spelled = cigar.reference_side(read, edits)
    assert ref[start : start + len(spelled)] == spelled and left == 0


def test_combine_finds_the_intron():
    rng = random.Random(5)
    exon1, exon2 = ("".join(rng.choice("ACGT") for _ in range(40)) for _ in range(2))
    intron = "GT" + "".join(rng.choice("ACGT") for _ in range(96)) + "AG"
    ref = exon1 + intron + exon2
    read = exon1[10:] + exon2[:30]
    found = kernels.combine(read, ref[10 : 10 + len(read) + 2], ref[: 10 + len(read) + 100][-len(read) - 2 :], 100)
    assert found["score"] == 0 and found["strand"] == "+" and found["canonical"]
    assert cigar.build_cigar(len(read), found["edits"]) == "30M100N30M"
    assert kernels.combine(read, ref[10 : 10 + len(read)], ref[10 : 10 + len(read)], 0)["kind"] == "none"


def test_one_gap_and_limits():
    assert kernels.one_gap("ACGTACGT", "ACGTTTACGT", 2) == (0, 3) or kernels.one_gap("ACGTACGT", "ACGTTTACGT", 2)[0] == 0
    assert kernels.edit_limit("AAAA", "AATT", 1) == 2 and kernels.edit_limit("AAAA", "AAAT", 3) == 1
    assert kernels.extend("ACGTACGT", "TTACGTACCT", 2, 4, 3, 0) == (2, 1)
