import gzip

import pytest
from pyspark.sql import functions as F

from seqloom.functions.config import Options
from seqloom.sources import annotations, reads, sinks


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def told(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">r1 x\nACGT\nAC\n>empty\n>r2\n#no\nGGTT\n")
    assert told(reads.fasta(spark, p), "rdid", "name", "seq", "qual") == [(0, "r1 x", "ACGTAC", "IIIIII"), (2, "r2", "GGTT", "IIII")]
    w = reads.sampled_windows(reads.fasta_records(spark, p), 4, 2)
    assert told(w, "seq") == [("ACGT",), ("GGTT",), ("GTAC",)]


def test_fastq_and_compression(spark, tmp_path):
    text = "@a 1\nACGT\n+\nIIII\n@b\nGG\n+\n!5\n"
    p = put(tmp_path, "a.fq", text)
    expected = [(0, "a 1", "ACGT", "IIII"), (1, "b", "GG", "!5")]
    assert told(reads.fastq(spark, p), "rdid", "name", "seq", "qual") == expected
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    assert told(reads.scan(spark, str(tmp_path / "b.fq.gz")), "rdid", "name", "seq", "qual") == expected
    q = put(tmp_path, "i.fq", "@a\nAC\n+\n40 -3\n")
    assert told(reads.fastq(spark, q, scale="integers"), "qual") == [("I!",)]
    q = put(tmp_path, "p64.fq", "@a\nAC\n+\nhB\n")
    assert told(reads.fastq(spark, q, scale="phred64"), "qual") == [("I#",)]
    with pytest.raises(ValueError):
        reads.scan(spark, p, "none")


def test_other_formats(spark, tmp_path):
    p = put(tmp_path, "t", "x\tAC\tII\ny\tAC\tII\tGG\tJJ\nz1\tAC\tII\tz2\tGG\tJJ\n")
    assert told(reads.tabbed(spark, p), "rdid", "mate", "name", "seq") == [(0, 0, "x", "AC"), (1, 1, "y", "AC"), (1, 2, "y", "GG"), (2, 1, "z1", "AC"), (2, 2, "z2", "GG")]
    p = put(tmp_path, "q", "m\t1\t2\t3\t4\t5\t0\t1\tAC.T\tIIII\t0\n")
    assert told(reads.qseq(spark, p), "name", "seq", "filter") == [("m_1_2_3_4_5_0/1", "ACNT", "0")]
    p = put(tmp_path, "r", "acgt\n\nGG\n")
    assert told(reads.raw(spark, p), "rdid", "name", "seq") == [(0, "0", "ACGT"), (2, "2", "GG")]
    assert told(reads.literal(spark, ["ACG", "TT"]), "rdid", "seq") == [(0, "ACG"), (1, "TT")]
    with pytest.raises(NotImplementedError):
        reads.accession(spark, "SRR0")


def test_pairs(spark, tmp_path):
    a, b = reads.literal(spark, ["AC", "GG"]), reads.literal(spark, ["TT", "CC"])
    assert told(reads.paired(a, b), "rdid", "mate", "seq") == [(0, 1, "AC"), (0, 2, "TT"), (1, 1, "GG"), (1, 2, "CC")]
    assert told(reads.interleaved(a), "rdid", "mate", "seq") == [(0, 1, "AC"), (0, 2, "GG")]
    with pytest.raises(Exception, match="same records"):
        reads.paired(a, reads.literal(spark, ["TT"])).collect()


def test_quality_file(spark, tmp_path):
    fa = put(tmp_path, "a.fa", ">x\nACG\n>y\nTT\n")
    qual = put(tmp_path, "a.qual", ">x\n40 40\n2\n>y\n0 1\n")
    assert told(reads.with_quality_file(reads.fasta(spark, fa), spark, qual), "name", "qual") == [("x", "II#"), ("y", '!"')]


def reference(spark, tmp_path):
    return annotations.reference(spark, put(tmp_path, "ref.fa", ">c1 first\nACGTACGTNNACGTACGTAC\n>c2\nGGGGCCCCAAAATTTT\n"))


def test_reference(spark, tmp_path):
    ref = reference(spark, tmp_path)
    assert told(ref, "chrom_id", "chrom", "len") == [(0, "c1", 20), (1, "c2", 16)]
    assert told(annotations.stretches(ref), "chrom_id", "tstart", "joined_start", "len") == [(0, 0, 0, 8), (0, 10, 8, 10), (1, 0, 18, 16)]
    at = annotations.reference_windows(spark.createDataFrame([("c2", 3, 4)], "chrom string, pos long, len long"), ref)
    assert told(at, "bases") == [("GCCC",)]


def test_variants_and_haplotypes(spark, tmp_path):
    ref = reference(spark, tmp_path)
    snp = put(tmp_path, "s", "ok\tsingle\tc1\t3\tA\nsame\tsingle\tc1\t3\tT\nn\tsingle\tc1\t8\tA\nbeside\tsingle\tc1\t7\tA\nchrom\tsingle\tcX\t3\tA\ndel\tdeletion\tc2\t4\t3\nlong\tinsertion\tc2\t4\t" + "A" * 33 + "\nins\tinsertion\tc2\t4\tAC\nend\tdeletion\tc2\t14\t5\n")
    vs = annotations.variants(spark, snp, ref)
    assert told(vs, "id") == [("del",), ("ins",), ("ok",)]
    ht = put(tmp_path, "h", "h1\tc2\t4\t6\tdel,gone,ins\nh2\tc2\t4\t6\tgone\n")
    assert told(annotations.haplotypes(spark, ht, vs), "hid", "alts") == [("h1", ["del", "ins"])]
    assert told(annotations.haplotypes(spark, None, vs), "hid", "left", "right") == [("ht_del", 4, 6), ("ht_ins", 4, 4), ("ht_ok", 3, 3)]


def test_sites_gtf_vcf(spark, tmp_path):
    ref = reference(spark, tmp_path)
    ss = put(tmp_path, "ss", "c1\t2\t12\t+\nc1\t2\t12\t-\nc1\t8\t12\t+\nc2\t5\t5\t+\nc2\t1\t99\t.\nc2\t1\t9\t.\n")
    assert [r[:3] for r in told(annotations.splice_sites(spark, ss, ref), "chrom", "left", "right")] == [("c1", 2, 12), ("c2", 1, 9)]
    gtf = put(tmp_path, "g", '#c\nc1\ts\texon\t5\t9\t.\t+\t.\tgene_id "g"; transcript_id "t"\nc1\ts\tCDS\t5\t9\t.\t+\t.\tgene_id "g"; transcript_id "t";\nc1\ts\texon\t9\t9\t.\t+\t.\tgene_id "g"; transcript_id "t";\nc1\ts\texon\t1\t9\t.\t+\t.\tgene_id "g";\n')
    assert told(annotations.gtf_exons(spark, gtf), "chrom", "left", "right", "gene_id", "transcript_id") == [("c1", 5, 9, "g", "t")]
    vcf = put(tmp_path, "v", "##x\n#CHROM\nc1\t4\trs1\tT\tA,C\t.\t.\tCLNSIG=5\tGT\t0|1:3\t2|0\nc1\t5\trs2\tA\tC\t.\t.\tCLNSIG=2\n")
    rows = annotations.vcf(spark, vcf)
    assert told(rows, "id", "pos", "alts", "genotypes") == [("rs1", 3, ["A", "C"], ["0|1", "2|0"]), ("rs2", 4, ["C"], None)]
    assert told(annotations.clinical(rows), "id") == [("rs1",)]


def test_dbsnp_and_repeats(spark, tmp_path):
    row = lambda name, strand, observed, kind, a, b, ref: "\t".join(["0", "c1", str(a), str(b), name, "0", strand, ref, ref, observed, "genomic", kind, *["x"] * 12, "0.8,0.2,", ""])
    p = put(tmp_path, "d", "\n".join([row("rs1", "-", "A/C", "single", 3, 4, "T"), row("rs1", "+", "T/C", "single", 3, 4, "T"), row("rs2", "+", "A/C", "single", 3, 5, "A"), row("rs3", "+", "-/GG", "insertion", 5, 5, "-")]) + "\n")
    assert told(annotations.dbsnp(spark, p), "id", "pos", "alleles", "frequencies") == [("rs1", 3, ["T", "G"], [0.8, 0.2]), ("rs3", 5, ["-", "GG"], [0.8, 0.2])]
    p = put(tmp_path, "r", ">rpt_1*0\trep\t0\t120\t2\t1\trps1\nc1:5:+ c2:9:-\n")
    assert [tuple(map(tuple, r[0])) for r in told(annotations.repeat_info(spark, p), "positions")] == [(("c1", 5, "+"), ("c2", 9, "-"))]


def test_sam(spark, tmp_path):
    p = put(tmp_path, "s", "@HD\tVN:1.0\nr\t0\tc1\t5\t60\t3M1D2M\t*\t0\t0\tACGTA\tIIIII\tNM:i:1\tMD:Z:3^A2\n")
    assert told(annotations.sam(spark, p), "qname", "pos", "end", "tags") == [("r", 4, 9, {"NM": "1", "MD": "3^A2"})]


def test_sinks(spark, tmp_path):
    ref = reference(spark, tmp_path)
    lines = [r.value for r in sinks.sam_header(ref, Options(rg_id="g", rg=("SM:s",))).orderBy("n").collect()]
    assert lines[0].startswith("@HD") and lines[1] == "@SQ\tSN:c1\tLN:20" and lines[3] == "@RG\tID:g\tSM:s" and lines[4].startswith("@PG")
    assert sinks.fasta_text(ref, 8).where("chrom_id = 1").first().value == ">c2\nGGGGCCCC\nAAAATTTT"
    assert sinks.sam_header(ref, Options(no_hd=True)).count() == 0
    alns = spark.createDataFrame([(0, 4, "UU"), (1, 0, "UU"), (2, 83, "CP"), (2, 163, "CP"), (3, 65, "DP"), (3, 129, "DP"), (1, 256, "UU")], "rdid long, flag int, yt string")
    rd = spark.createDataFrame([(k, f"r{k}", "AC", "II") for k in range(4)], "rdid long, name string, seq string, qual string")
    got = {k: [r.rdid for r in v.collect()] for k, v in sinks.route(rd, alns).items()}
    assert got == {"un": [0], "al": [1], "un_conc": [3], "al_conc": [2], "al_conc_disc": [2, 3]} or {k: sorted(v) for k, v in got.items()} == {"un": [0], "al": [1], "un_conc": [3], "al_conc": [2], "al_conc_disc": [2, 3]}
    assert sinks.fastq_lines(rd).first().value == "@r0\nAC\n+\nII"
    assert sinks.index_summary(ref, spark.createDataFrame([("AC", 0)], "kmer string, chrom_id long")).first().bases == 36
    assert sinks.results_table(spark, str(tmp_path / "res"), [("a", 1.5)], "tool string, seconds double").count() == 1
    assert sinks.metrics_rows(spark.range(10).select(F.col("id").alias("rdid")), "rdid", 4).orderBy("step").collect()[-1].total == 10


def test_numbers_of_a_shuffle(spark):
    """Rows behind a shuffle whose partitions AQE merges by the size of the columns that are read."""
    wanted = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64kb", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide")).repartition(4)
        got = reads.with_ordinal(rows.repartitionByRange("id").sortWithinPartitions("id"), "n").collect()
        assert sorted((r.id, r.n) for r in got) == [(k, k) for k in range(4000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_order_of_files(spark, tmp_path):
    """Files count in the order of their names, though Spark reads the larger ones first."""
    row = lambda chrom, end: "\t".join(["0", chrom, "10", str(end), "rs1", "0", "+", "A", "0", "A/C", "genomic", "single", *["0"] * 12, "0.5,", "0"])
    (tmp_path / "snps").mkdir()
    put(tmp_path / "snps", "a.txt", row("c1", 11) + "\n")
    put(tmp_path / "snps", "b.txt", (row("c2", 11) + "\n") * 50)
    assert told(annotations.dbsnp(spark, str(tmp_path / "snps")), "chrom") == [("c1",)]
    (tmp_path / "fasta").mkdir()
    put(tmp_path / "fasta", "a.fa", ">x\nACGTAC\n")
    put(tmp_path / "fasta", "b.fa", ">y\n" + "G" * 40 + "\n")
    w = reads.sampled_windows(reads.fasta_records(spark, str(tmp_path / "fasta")), 4, 2)
    assert told(w, "rdid", "name")[:3] == [(0, "x_1"), (1, "x_3"), (2, "y_1")]


def test_routed_in_one_pass(spark):
    """All kinds come of one join, so that a kind's rows do not lie in the few tasks of a join of its own."""
    from seqloom.plans import queries_io

    alns = spark.createDataFrame([(0, 4, "UU"), (1, 0, "UU"), (2, 83, "CP"), (3, 65, "DP"), (1, 256, "UU")], "rdid long, flag int, yt string")
    rows = sinks.routed(spark.range(5).withColumnRenamed("id", "rdid"), alns)
    assert {r.rdid: r.kinds for r in rows.collect()} == {0: ["un"], 1: ["al"], 2: ["al_conc", "al_conc_disc"], 3: ["un_conc", "al_conc_disc"], 4: ["un"]}
    plan = queries_io.routed_reads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
