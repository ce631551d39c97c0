"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import pytest
from compare import connect, same

from seqloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(QUERIES[name](spark, SF), connect(SF).sql(SQL[name]))


def test_queries_without_sql_are_these():
    assert set(QUERIES) - set(SQL) == {"gapped_alignments", "sam_lines", "greedy_haplotypes"}


def test_alignments_spell_the_reference(spark):
    """Every alignment's MD and CIGAR give the bases of its place, and its edits its score; SAM lines tell the same alignments."""
    from seqloom.functions.cigar import edits_of, reference_side
    from seqloom.operators.variants import edit_score
    from seqloom.plans.registry import K, Options, alignments_of

    reads, alns, ref = alignments_of(spark, SF, Options(kmer=K, spliced=False, norc=True))
    seqs, refs = {r.rdid: r.seq for r in reads.collect()}, {r.chrom_id: r.seq for r in ref.collect()}
    rows = QUERIES["gapped_alignments"](spark, SF).collect()
    for r in rows:
        edits = edits_of(seqs[r.rdid], r.cigar, r.md)
        spelled = reference_side(seqs[r.rdid], edits)
        assert refs[r.chrom_id][r.pos : r.pos + len(spelled)] == spelled and edit_score(edits) == r.score
    best = {}
    for r in rows:
        best.setdefault(r.rdid, []).append(r)
    names = {r.name: r.rdid for r in reads.collect()}
    lines = [x.value.split("\t") for x in QUERIES["sam_lines"](spark, SF).collect()]
    assert {names[x[0]] for x in lines} == set(best)
    for x in lines:
        found = [r for r in best[names[x[0]]] if r.score == max(q.score for q in best[r.rdid])]
        assert any((f"b{r.chrom_id}", r.pos + 1, r.cigar) == (x[2], int(x[3]), x[5]) for r in found) and x[9] == seqs[names[x[0]]]


def test_haplotypes_against_the_rules(spark):
    """Each variant is on a haplotype, no two on one haplotype exclude each other, and neighbours lie at most 50 bases apart."""
    from seqloom.operators import annotation
    from seqloom.plans.registry import variants_of

    vs = {r.id2: r for r in annotation.suffix_ids(annotation.distinct_variants(variants_of(spark, SF).selectExpr("cast(id as string) as id", "chrom", "pos", "type", "data"))).collect()}
    end = lambda v: v.pos + (int(v.data) - 1 if v.type == "D" else 0)
    seen = set()
    for h in QUERIES["greedy_haplotypes"](spark, SF).collect():
        own = [vs[x] for x in h.alts]
        seen |= set(h.alts)
        assert {str(v.chrom) for v in own} == {h.chrom} and h.left <= own[0].pos and h.right == end(own[-1])
        for a, b in zip(own, own[1:], strict=False):
            assert b.pos > end(a) and b.pos <= end(a) + 50
    assert seen == set(vs)


def test_entry(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_names_are_aligned_once(spark, monkeypatch):
    """dp_edit_distance aligns different texts, of which many parts have one."""
    from seqloom.operators import kernels

    asked, real = [], kernels.align_candidates
    monkeypatch.setattr(kernels, "align_candidates", lambda c, *a, **k: asked.append(c.count()) or real(c, *a, **k))
    names = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_name").distinct().count()
    pairs = QUERIES["dp_edit_distance"](spark, "/root/testdata/sf0.01").count()
    assert 0 < asked[0] <= names**2 < pairs


def of_bases(tmp_path, spark, docs):
    """A folder of documents (doc_id, bases), which are letters that stand for their bases."""
    letters = str.maketrans("ACGT", "abcd")
    spark.createDataFrame([(k, x.translate(letters)) for k, x in docs], "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path)


def asked(folder, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    return c.sql(SQL[name])


def periodic(unit, before, after, at=100):
    """At least 600 bases: a stretch of copies of unit from before to after the sixty bases at a place, among others."""
    import random

    some = random.Random(1)
    x = lambda n: "".join(some.choice("ACGT") for _ in range(n))
    return x(at - before) + (unit * 120)[: before + 60 + after] + x(600)


@pytest.mark.parametrize("name", ["soft_clips", "local_alignments"])
def test_every_place_of_a_read_in_a_repeat(spark, tmp_path, name):
    """Reads in stretches of a short unit align as well or better some bases beside their own place, which counts all the same."""
    docs = [(k, periodic(unit, before, after)) for k, (unit, before, after) in enumerate((u, b, a) for u in ("A", "AG", "TTA", "TGAC", "AAAAC", "TTGAAC") for b in (0, 7, 13, 28) for a in (0, 1, 13, 24))]
    folder = of_bases(tmp_path, spark, docs)
    same(QUERIES[name](spark, folder), asked(folder, name))


def test_sites_tell_which_copy_of_an_exon_counts(spark, tmp_path):
    """The second exon stands in a stretch of copies of a unit, where several places cover the read as well."""
    doc = (
        "GAGTAATTAGCCACTACTTTCATAAGGCTTGTTTGCCTGCGACTAATGATAGCGTGCTACACTACCTGTACCTGTACCTGTACCTGTACCTGTACCTGTACCT"
        "GTACCTGTACCTGTACCTGTACCTGTACCTGTTTAGTTAGTTAGTTAGTTAGTTAGTTAGTTAGTTAGTTAGTTAGTTAGCTCTCTCTCTCTCTCTCTCTCTC"
        "TCTACCTACTACCTACTACCTACTACCTACTACCTACTACCTACTACCTACTACCTACTACCTACTACCTACTACCTACTACCTACACACACACACACACACA"
        "CACACATTTTGCACTTTTGCACTTTTGCACTTTTGCACTTTTGCACTTTTGCACTTTTGCACTTTTGCACTTTTGCACTTTTGCACTTTTGCACTTTTGCACA"
        "GTACTAGTACTAGTACTAGTACTAGTACTAGTACTAGTACTAGTACTAGTACTAGTACTAGTACTAGTACTATTAAAATTAAAATTAAAATTAAAATTAAAAT"
        "TAAAATTAAAATTAAAATTAAAATTAAAATTAAAATTAAAGAGTAATTAGCCACTACTTTCATAAGGCTTGTTTGCCTGCGACTAATGATAGCGTGCTACACT"
    )
    folder = of_bases(tmp_path, spark, [(0, doc)])
    want = asked(folder, "spliced_reads")
    assert want.fetchall()
    same(QUERIES["spliced_reads"](spark, folder), want)


def test_variants_of_a_place_that_looks_like_its_neighbour(spark, tmp_path):
    """A read whose variants make it equal to the bases ten places on still aligns at its own place, where its variants cost nothing."""
    import random

    some = random.Random(3)
    x = lambda n: "".join(some.choice("ACGT") for _ in range(n))
    docs = [(8 * k + 7, x(100) + "".join(b + unit for b in "AACCAACC") + x(500)) for k, unit in enumerate(x(9) for _ in range(12))]
    folder = of_bases(tmp_path, spark, docs)
    same(QUERIES["variant_reads"](spark, folder), asked(folder, "variant_reads"))


def test_redundant_ranges_are_told_without_their_pairs(spark):
    """Ranges inside one another, equal ones and ones of one start, against all pairs; no join of the plan compares two places."""
    import random

    from seqloom.operators import repeats

    some = random.Random(5)
    rows = [(k, k % 3, s, s + some.choice((0, 3, 3, 7, 20))) for k in range(400) for s in (some.randrange(60),)] + [(900, None, 1, 2), (901, 1, None, 2)]
    df = spark.createDataFrame(rows, "id long, chrom_id long, start long, end long")
    told = [r for r in rows if None not in r]
    want = {a[0] for a in told for b in told if a[1] == b[1] and a[0] != b[0] and b[2] <= a[2] and a[3] <= b[3] and (a[2:] != b[2:] or b[0] < a[0])}
    got = repeats.redundant(df)
    assert sorted(r.id for r in got.collect()) == sorted(want)
    joined = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joined and not any(" >= " in x or " <= " in x for x in joined)


@pytest.mark.parametrize("name", ["repeat_overlaps", "name_distance", "haplotypes_over"])
def test_pairs_are_dealt_to_tasks(spark, name):
    """Joins whose few rows make many pairs keep their tasks, which AQE would put together by the size of the rows."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 2 or plan.count("Repartition") >= 2


def test_narrow_bins_of_repeats(spark, monkeypatch):
    """Places of repeats of one chromosome are not all compared with one another."""
    from seqloom.operators import intervals, repeats

    seen, real = [], intervals.overlap_join
    monkeypatch.setattr(repeats, "overlap_join", lambda x, y, keys, width=16384, *a, **k: seen.append(width) or real(x, y, keys, width, *a, **k))
    rows = [(k, 0, 60 * k, 60 * k + 30) for k in range(50)] + [(100, 0, 0, 500)]
    got = repeats.overlaps(spark.createDataFrame(rows, "id long, chrom_id long, start long, end long")).collect()
    assert seen[0] <= 128 and {(r.a, r.b, r.kind) for r in got} == {(k, 100, "inside" if 60 * k + 30 <= 500 else "overlap") for k in range(9)}


def test_missing_names_and_equal_keys(spark, tmp_path):
    """name_distance on parts without a name, a brand or a key, and with a key twice."""
    import duckdb

    c = duckdb.connect()
    c.sql(f"copy (select * from (values (1, 'a', 'x', 1), (2, NULL, 'x', 1), (3, NULL, 'x', 1), (3, 'ab', 'x', 1), (4, 'a', 'x', 1), (4, 'b', NULL, 1), (NULL, 'a', 'x', 1), (5, 'a', NULL, 1)) v(p_partkey, p_name, p_brand, p_size)) to '{tmp_path}/part.parquet' (format parquet)")
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    got = QUERIES["name_distance"](spark, str(tmp_path))
    same(got, c.sql(SQL["name_distance"]))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("collect_list") >= 2


def test_kmers_are_moved_once(spark):
    """repeat_kmers counts documents and places of a k-mer where its rows lie: one shuffle by k-mer, and none by document."""
    plan = QUERIES["repeat_kmers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
