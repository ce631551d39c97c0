"""Alignment as one plan: reads -> filters -> seeds -> diagonals -> extension -> ranking -> pairs -> records.

All candidates are made set-wise and ranked; nothing depends on the order of work. Seeds are an
equality join on k-mers, whose reference side is broadcast only if its size was checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import EDIT, cigar_of, clip, md_of, read_span
from ..functions.config import Options
from ..functions.sam import counted_edits, filter_tag, flag, known_variant_tag, pair_class_tag, strand_tag, template_length
from ..functions.scoring import composite_score
from ..functions.seq import canonical_junction, clean_name, read_seed, reverse_complement, trim, window_rows
from ..operators.chaining import chained_alignments, end_parts, site_kmers, site_parts
from ..operators.common_seeds import common_kmers, repeated_pieces, spread, with_common
from ..operators.filters import filtered, sample, skip_upto, strands, transcriptome_only
from ..operators.index import OVERLAP, bases_at, kmer_index, total_bases, variant_windows
from ..operators.kernels import align_candidates, clip_candidates
from ..operators.metrics import novel_sites, site_support
from ..operators.pairing import concordant_pairs, rescue
from ..operators.ranking import best_and_second, category, distinct_alignments, mapq, needed_introns, seed_cap, top_k
from ..operators.variants import apply_known
from ..sources.scratch import written
from ..sources.sinks import tags

#: Index rows that may be broadcast (about 60 bytes each); larger indexes are joined by shuffle.
MAX_BROADCAST_INDEX = 500_000


def bounded(df: DataFrame, rows: int, known: int | None = None) -> DataFrame:
    """df with a broadcast hint if it holds at most so many rows: by a bound that is known, else counted."""
    return F.broadcast(df) if (df.count() if known is None else known) <= rows else df


def prepare(reads: DataFrame, o: Options = Options()) -> DataFrame:
    """Limits, sample, trimming and filter reasons (yf)."""
    kept = skip_upto(reads, o.skip, o.upto)
    if o.sample < 1:
        kept = sample(kept, o.sample, o.seed)
    cut = kept.withColumn("seq", trim("seq", o.trim5, o.trim3)).withColumn("qual", trim("qual", o.trim5, o.trim3))
    return filtered(cut, o)


def seed_hits(stranded: DataFrame, index: DataFrame, k: int, max_hits: int | None = None, step: int = 1, rows: int | None = None, common: DataFrame | None = None) -> DataFrame:
    """(rdid, mate, fw, rdoff, chrom_id, pos) of exact k-mers of stranded reads (rdid, mate, fw, s). K-mers with more than max_hits places, or those in common (kmer), give none. rows: a bound of the index's rows that is known."""
    grams = window_rows(stranded, ["rdid", "mate", "fw"], "s", k, step).withColumnRenamed("pos", "rdoff")
    table = index.select("kmer", "chrom_id", "pos")
    if common is None and max_hits is not None:
        common = common_kmers(table, max_hits)
    if common is not None:
        table = table.join(common, "kmer", "left_anti")
    return grams.join(bounded(table, MAX_BROADCAST_INDEX, rows), "kmer").drop("kmer")


def anchored_hits(stranded: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    """seed_hits() of all k-mers of ref, with few rows for each read: any k bases hold just one piece of k // 2 bases that begins at a multiple of k - k // 2 + 1, so these pieces alone are looked up, and what lies around a piece tells which k-mers agree. References too large to be broadcast are looked up k-mer by k-mer."""
    bases = total_bases(ref)
    if bases > MAX_BROADCAST_INDEX:
        return seed_hits(stranded, kmer_index(ref, k), k, rows=bases)
    index = _pieces(ref, ["chrom_id"], F.regexp_replace("seq", "[^ACGT]", ">"), ">", k, 1, "_ref", "_pos")
    index = index.where(~F.contains("_piece", F.lit(">")))
    pieces = _pieces(stranded.where(F.length("s") >= k), ["rdid", "mate", "fw"], F.col("s"), "<", k, k - k // 2 + 1, "_read", "_rdoff")
    return _agreeing(pieces.join(F.broadcast(index), "_piece"), k)


def targeted_hits(stranded: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    """seed_hits() of stranded reads (rdid, mate, fw, s, target) on the sequence that target names, looked up as in anchored_hits(), but with the pieces that begin at a multiple taken from ref."""
    step = k - k // 2 + 1
    index = _pieces(ref, ["chrom_id"], F.regexp_replace("seq", "[^ACGT]", ">"), ">", k, step, "_ref", "_pos")
    index = index.where(~F.contains("_piece", F.lit(">")))
    pieces = _pieces(stranded.where(F.length("s") >= k), ["rdid", "mate", "fw", F.col("target").alias("chrom_id")], F.col("s"), "<", k, 1, "_read", "_rdoff", ["rdid", "mate", "fw", "chrom_id"])
    return _agreeing(pieces.join(index, ["chrom_id", "_piece"]), k)


def _pieces(df: DataFrame, keep: list, seq, letter: str, k: int, step: int, around: str, at: str, names: list[str] | None = None) -> DataFrame:
    """keep, at, _piece: pieces of k // 2 bases of seq, every step bases, and around: each with the bases beside it; letter stands beyond the ends."""
    s, side = k // 2, k - k // 2
    padded = F.concat(F.lit(letter * side), seq, F.lit(letter * side))
    rows = window_rows(df.select(*keep, padded.alias("_p")), names or keep, "_p", s + 2 * side, step)
    return rows.select(*(names or keep), F.col("pos").alias(at), F.col("kmer").alias(around), F.substring("kmer", side + 1, s).alias("_piece"))


def _agreeing(met: DataFrame, k: int) -> DataFrame:
    """Hits (rdid, mate, fw, rdoff, chrom_id, pos) of k bases over the pieces that reads and sequences share. The two sides have different letters beyond their ends, and in place of unknown bases, so nothing agrees there."""
    side = k - k // 2
    same = F.filter(F.sequence(F.lit(0), F.lit(side)), lambda i: F.substring(F.col("_read"), i + 1, F.lit(k)) == F.substring(F.col("_ref"), i + 1, F.lit(k)))
    found = met.select("rdid", "mate", "fw", "_rdoff", "chrom_id", "_pos", F.explode(same).alias("_i"))
    return found.select("rdid", "mate", "fw", (F.col("_rdoff") + F.col("_i") - side).alias("rdoff"), "chrom_id", (F.col("_pos") + F.col("_i") - side).alias("pos"))


def partial_hits(hits: DataFrame, k: int) -> DataFrame:
    """(rdid, mate, fw, chrom_id, diagonal, rdoff, pos, len): runs of neighbouring k-mer hits on one diagonal, which are the longest exact matches."""
    keys = ["rdid", "mate", "fw", "chrom_id", "diagonal"]
    d = hits.withColumn("diagonal", F.col("pos") - F.col("rdoff"))
    w = Window.partitionBy(*keys).orderBy("rdoff")
    new = F.coalesce(F.col("rdoff") - F.lag("rdoff").over(w) > 1, F.lit(True)).cast("int")
    runs = d.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg(F.min("rdoff").alias("rdoff"), F.min("pos").alias("pos"), (F.max("rdoff") - F.min("rdoff") + k).alias("len"))
    return out.drop("_run")


def diagonals(hits: DataFrame, k: int) -> DataFrame:
    """(rdid, mate, fw, chrom_id, diagonal, hits, covered): chains of hits on one diagonal."""
    chained = partial_hits(hits, k).groupBy("rdid", "mate", "fw", "chrom_id", "diagonal")
    return chained.agg((F.sum("len") - (k - 1) * F.count("*")).alias("hits"), F.sum("len").alias("covered"))


def candidates(parts: DataFrame, o: Options = Options()) -> DataFrame:
    """One place for each chain, the longest ones first, o.seeds of them for each read and strand."""
    best = parts.groupBy("rdid", "mate", "fw", "chrom_id", "diagonal").agg(F.sum("len").alias("len"))
    return seed_cap(best.withColumn("pos", F.col("diagonal")), ["rdid", "mate"], o.seeds).drop("pos")


def extend_candidates(cands: DataFrame, stranded: DataFrame, ref: DataFrame, o: Options = Options(), slack: int = 12, every: bool = False, bases: int | None = None) -> DataFrame:
    """Gapped alignment of each candidate in its reference window, and its own diagonal where that is another place: (rdid, mate, fw, chrom_id, pos, score, cigar, md, edits, len, splice_strand); every: those under the least score, too."""
    j = cands.join(stranded.select("rdid", "mate", "fw", F.col("s").alias("read"), F.col("q").alias("qual")), ["rdid", "mate", "fw"])
    start = F.greatest(F.col("diagonal") - slack, F.lit(0))
    j = j.withColumn("start", start).withColumn("_n", F.col("diagonal") + F.length("read") + slack - start)
    longest = stranded.agg(F.coalesce(F.max(F.length("s")), F.lit(0))).first()[0] + 2 * slack
    j = bases_at(j, ref, "start", "_n", "window", longest=max(OVERLAP, longest), bases=bases).withColumn("lead", (F.col("diagonal") - F.col("start")).cast("int"))
    told = j.select("rdid", "mate", "fw", "chrom_id", "start", "read", "qual", "window", "lead")
    # with every, what edits cost is not known yet, so no alignment is better than another
    done = clip_candidates(told, o.scoring, o.local, every) if o.soft_clip or o.local else align_candidates(told, o.scoring, always=every).withColumn("right_clip", F.lit(0))
    n = F.length("read")
    least = o.least_score.whole(n)
    placed = (done if every else done.where(F.col("score") >= least)).withColumn("pos", F.col("start") + F.col("ref_start"))
    return _spelled(placed.withColumn("len", n).withColumn("splice_strand", F.lit(None).cast("string")))


def _spelled(placed: DataFrame) -> DataFrame:
    """Alignments with their CIGAR and MD, from edits, len and the clipped ends."""
    inside = F.col("len") - F.col("left_clip") - F.col("right_clip")
    return placed.select("rdid", "mate", "fw", "chrom_id", "pos", "score", cigar_of(inside, "edits", "left_clip", "right_clip").alias("cigar"), md_of(inside, "edits").alias("md"), "edits", "len", "splice_strand")


def chained_candidates(parts: DataFrame, stranded: DataFrame, ref: DataFrame, o: Options = Options(), bases: int | None = None, sites: DataFrame | None = None) -> DataFrame:
    """Alignments over any number of introns and gaps, from chains of the partial hits of a read on one strand.

    With sites (chrom_id, left, right, fw), k-mers over their junctions are partial hits on both sides,
    so a read finds a known intron of which it has min_anchor bases only. With o.end_kmer, what the
    partial hits leave unexplained at the ends of a read is searched by shorter k-mers beside them.
    """
    plain = lambda x: x.withColumn("known", F.lit(None).cast("long")).withColumn("forward", F.lit(None).cast("boolean"))
    every = plain(parts)
    if sites is not None:
        spanning = site_kmers(ref, sites, o.kmer, min(o.scoring.min_anchor, o.kmer // 2), bases)
        every = every.unionByName(site_parts(stranded, spanning, o.kmer))
    if o.end_kmer:
        hits = end_parts(parts, stranded, kmer_index(ref, o.end_kmer), o.end_kmer, o)
        every = every.unionByName(plain(partial_hits(hits, o.end_kmer)))
    return _spelled(chained_alignments(every, stranded, ref, o, bases))


def rescued(found: DataFrame, ready: DataFrame, stranded: DataFrame, ref: DataFrame, o: Options, bases: int | None = None) -> DataFrame:
    """Alignments of mates that have none in found, by k-mers of o.rescue_kmer bases in the tiles near their anchored mates, and only where the pair policy lets them lie."""
    from ..functions.cigar import cigar_end

    anchors = found.where("mate > 0").select("rdid", "mate", "chrom_id", "pos", cigar_end(F.col("pos"), F.col("cigar")).alias("end"), "fw")
    index = kmer_index(ref, o.rescue_kmer)
    hits = rescue(anchors, ready.where("mate > 0").select("rdid", "mate", "seq"), index, o.rescue_kmer, o)
    return extend_candidates(candidates(partial_hits(hits, o.rescue_kmer), o), stranded, ref, o, bases=bases)


def repeat_candidates(stranded: DataFrame, ref: DataFrame, index: DataFrame, common: DataFrame, o: Options, bases: int | None = None) -> DataFrame:
    """Alignments of reads with common k-mers (common: kmer): placed on the distinct repeated pieces first, then on o.seeds copies of each."""
    own = written(with_common(stranded, common, o.kmer), "common-reads")
    longest = own.agg(F.coalesce(F.max(F.length("s")), F.lit(0))).first()[0]
    pieces, places = repeated_pieces(ref, index, common, o.kmer, longest + 24, bases)
    parts = partial_hits(seed_hits(own, kmer_index(pieces, o.kmer), o.kmer), o.kmer)
    found = extend_candidates(candidates(parts, o), own, pieces, o)
    return extend_candidates(spread(found, pieces, places, o.seeds, o.seed), own, ref, o, bases=bases)


def align(reads: DataFrame, ref: DataFrame, index: DataFrame, o: Options = Options(), variants: DataFrame | None = None, exons: DataFrame | None = None, known: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """All alignments that reach the least score: (rdid, mate, chrom_id, pos, end, fw, score, cigar, md, edits, len, splice_strand).

    K-mers with more than o.max_hits places are not looked up one by one: reads that have them are placed
    on the distinct repeated pieces of the reference, and get o.seeds of the copies of each, which tie.

    Reads with a target (a chrom_id) are searched on that sequence only, by pieces of its k-mers and not
    by index; on one sequence no k-mer is too common.

    With variants (chrom_id, id, type, pos, data), k-mers that cross up to max_alternatives
    combinations of them are seeds, too, and edits that are known variants cost nothing. With
    o.rescue_kmer, mates without an alignment are searched again with shorter k-mers in the tiles near
    their anchored mates. With o.transcriptome_only, alignments stay whose junctions are all in known
    (chrom_id, left, right), or that lie in one of exons (chrom_id, left, right). With sites
    (chrom_id, left, right, fw: known splice sites), reads are also searched over their junctions. With
    o.soft_clip or o.local, ends may be clipped; they stand in the CIGAR, and edits count from the first
    base that is not clipped. An intron that gains nothing is left out: of alignments with one start or
    end, those stay that no one with fewer introns equals.
    """
    from ..functions.cigar import cigar_end, cigar_junctions

    ready = prepare(reads, o).where("yf is null")
    both = strands(ready, o.nofw, o.norc, o.policy)
    targeted = "target" in both.columns
    stranded = both.select("rdid", "mate", "fw", F.when(F.col("fw"), F.col("seq")).otherwise(reverse_complement("seq")).alias("s"), F.when(F.col("fw"), F.col("qual")).otherwise(F.reverse("qual")).alias("q"), *(["target"] if targeted else []))
    bases, common = total_bases(ref), None
    crossing = variant_windows(ref, variants, o.kmer, o.max_alternatives).select("kmer", "chrom_id", "pos") if variants is not None else None
    if targeted:
        hits = targeted_hits(stranded, ref, o.kmer)
        if crossing is not None:
            grams = window_rows(stranded, ["rdid", "mate", "fw", "target"], "s", o.kmer).withColumnRenamed("pos", "rdoff").withColumnRenamed("target", "chrom_id")
            hits = hits.unionByName(grams.join(crossing.distinct(), ["kmer", "chrom_id"]).drop("kmer")).distinct()
    else:
        seeds = index.select("kmer", "chrom_id", "pos")
        if crossing is not None:
            seeds = seeds.unionByName(crossing).distinct()
        common = written(common_kmers(seeds, o.max_hits), "common") if o.max_hits is not None else None
        if common is not None and common.isEmpty():
            common = None
        # an index has at most a row for each base; with variants it is counted
        hits = seed_hits(stranded, seeds, o.kmer, rows=bases if variants is None else None, common=common)
    parts = partial_hits(hits, o.kmer)
    found = extend_candidates(candidates(parts, o), stranded, ref, o, every=variants is not None, bases=bases)
    if o.spliced:
        found = found.unionByName(chained_candidates(parts, stranded, ref, o, bases, sites))
    if common is not None:
        found = found.unionByName(repeat_candidates(stranded, ref, index.select("kmer", "chrom_id", "pos"), common, o, bases))
    if o.rescue_kmer:
        found = found.unionByName(rescued(found, ready, stranded, ref, o, bases))
    placed = found.withColumn("end", cigar_end(F.col("pos"), F.col("cigar")))
    if o.transcriptome_only:
        told = placed.withColumn("start", F.col("pos")).withColumn("junctions", cigar_junctions(F.col("pos"), F.col("cigar")))
        placed = transcriptome_only(told, exons, known).select(*placed.columns)
    if variants is not None:
        placed = apply_known(placed, variants, o.scoring).where(F.col("score") >= o.least_score.whole(F.col("len")))
    if o.spliced:
        placed = needed_introns(placed, ["rdid", "mate"], F.size(F.filter("edits", lambda e: e["type"] == "spl")))
    return distinct_alignments(placed, ["rdid", "mate"])


def first_pass_sites(alns: DataFrame, ref: DataFrame) -> DataFrame:
    """(chrom_id, left, right, fw) of the splice sites that alignments show with enough support."""
    return novel_sites(site_support(junction_uses(alns, ref))).select("chrom_id", "left", "right", "fw")


def align_twice(reads: DataFrame, ref: DataFrame, index: DataFrame, o: Options = Options(), sites: DataFrame | None = None) -> DataFrame:
    """align() in two passes: the splice sites that the first one shows, and those in sites, are known to the second one, which searches the reads that the first one has not placed without a loss."""
    first = written(align(reads, ref, index, o, sites=sites), "first-pass")
    shown = first_pass_sites(first, ref)
    known = written((shown if sites is None else shown.unionByName(sites.select(*shown.columns))).distinct(), "sites")
    settled = first.where(F.col("score") >= 0).select("rdid", "mate")
    again = align(reads.join(settled, ["rdid", "mate"], "left_anti"), ref, index, o, sites=known)
    return distinct_alignments(first.unionByName(again), ["rdid", "mate"])


def junction_uses(alns: DataFrame, ref: DataFrame) -> DataFrame:
    """(rdid, chrom_id, left, right, fw, left_anchor, right_anchor, mismatches, canonical) of the introns of alignments, as operators.metrics.site_support takes them.

    An anchor is what the read has between this intron and the next one or its end.
    """
    spliced = alns.where(F.exists("edits", lambda e: e["type"] == "spl"))
    width = lambda e: F.when(e["type"].isin("del", "spl"), e["length"]).when(e["type"] == "ins", -e["length"]).otherwise(0)
    introns = F.filter("edits", lambda e: e["type"] == "spl")
    rows = spliced.select("rdid", "chrom_id", "pos", (read_span(F.col("cigar")) - clip(F.col("cigar")) - clip(F.col("cigar"), False)).alias("len"), "edits", "splice_strand", introns.alias("_i"), F.posexplode(introns).alias("_k", "_e"))
    before = F.coalesce(F.try_element_at("_i", F.when(F.col("_k") > 0, F.col("_k")).otherwise(F.size("_i") + 1))["pos"], F.lit(0))
    after = F.coalesce(F.try_element_at("_i", F.col("_k") + 2)["pos"], F.col("len"))
    here = F.col("_e.pos")
    shift = F.aggregate(F.filter("edits", lambda e: e["pos"] < here), F.lit(0), lambda a, e: a + width(e))
    left = F.col("pos") + here + shift - 1
    mm = F.size(F.filter("edits", lambda e: (e["type"] != "spl") & e["snp"].isNull()))
    out = rows.select("rdid", "chrom_id", left.cast("long").alias("left"), (left + F.col("_e.length") + 1).cast("long").alias("right"), (F.col("splice_strand") == "+").alias("fw"), (here - before).alias("left_anchor"), (after - here).alias("right_anchor"), mm.alias("mismatches"))
    ends = out.withColumn("_two", F.lit(2)).withColumn("_a", F.col("left") + 1).withColumn("_z", F.col("right") - 2)
    n = total_bases(ref)
    at = bases_at(bases_at(ends, ref, "_a", "_two", "_donor", bases=n), ref, "_z", "_two", "_acceptor", bases=n)
    return at.withColumn("canonical", canonical_junction(F.col("_donor"), F.col("_acceptor"))).drop("_two", "_a", "_z", "_donor", "_acceptor")


def report(reads: DataFrame, alns: DataFrame, ref: DataFrame, o: Options = Options()) -> DataFrame:
    """Records: for each read its reported alignments, or one unmapped record.

    Pairs are concordant before discordant before single mates; ties are ordered by a hash of the
    read; at most khits are reported, and without secondary only those that tie with the best.
    """
    ready = prepare(reads, o)
    seeds = ready.select("rdid", "mate", read_seed(F.col("seq"), F.col("qual"), F.col("name"), o.seed).alias("_seed"))
    rank = composite_score(F.col("score"), F.lit(0), F.lit(0), F.aggregate(F.filter("edits", lambda e: e["type"] == "spl"), F.lit(0), lambda a, e: a + 1) * 100, F.lit(0))
    scored = alns.join(seeds, ["rdid", "mate"]).withColumn("rank_score", rank).withColumn("tie", F.xxhash64("_seed", "chrom_id", "pos", "fw"))
    single = scored.withColumn("unit", F.col("mate"))
    pairs = concordant_pairs(scored.where("mate > 0"), o)
    n_pairs = pairs.groupBy("rdid").agg(F.count("*").alias("n_pairs"))
    n_mates = scored.groupBy("rdid").agg(F.count_if(F.col("mate") == 1).alias("n1"), F.count_if(F.col("mate") == 2).alias("n2"), F.count_if(F.col("mate") == 0).alias("n0"))
    per = ready.groupBy("rdid").agg((F.max("mate") > 0).alias("paired")).join(n_pairs, "rdid", "left").join(n_mates, "rdid", "left").fillna(0, ["n_pairs", "n1", "n2", "n0"])
    per = per.withColumn("category", F.when(F.col("paired"), category(F.col("n_pairs"), F.col("n1"), F.col("n2"), o.discordant, o.mixed)).when(F.col("n0") > 0, "unpaired").otherwise("none"))

    told = [c for c in scored.columns if c not in ("rdid", "unit", "_seed", "tie", "rank_score")]
    best_pairs = top_k(pairs.withColumn("tie", F.xxhash64("rdid", "a.pos", "b.pos", "a.chrom_id")), ["rdid"], o.khits, "score", "tie", o.secondary)
    as_mates = best_pairs.select("rdid", "rank", F.explode(F.array("a", "b")).alias("m"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    other = F.when(F.col("m.mate") == 1, F.col("_b")).otherwise(F.col("_a"))
    from_pairs = as_mates.select("rdid", "rank", *(F.col(f"m.{c}").alias(c) for c in told), F.struct(other["chrom_id"].alias("chrom_id"), other["pos"].alias("pos"), other["end"].alias("end"), other["fw"].alias("fw"), other["score"].alias("score"), other["cigar"].alias("cigar")).alias("other"))
    alone = per.where("category in ('unpaired', 'discordant')").select("rdid")
    best_single = top_k(single.join(alone, "rdid", "left_semi"), ["rdid", "mate"], o.khits, "rank_score", "tie", o.secondary)
    w = Window.partitionBy("rdid")
    mate_of = lambda m: F.max(F.when((F.col("mate") == m) & (F.col("rank") == 1), F.struct("chrom_id", "pos", "end", "fw", "score", "cigar"))).over(w)
    from_single = best_single.withColumn("other", F.when(F.col("mate") == 1, mate_of(2)).when(F.col("mate") == 2, mate_of(1))).select("rdid", "rank", *told, "other")
    mapped = from_pairs.unionByName(from_single)

    firsts = best_and_second(scored, ["rdid", "mate"])
    counts = mapped.groupBy("rdid", "mate").agg(F.count("*").alias("nh"))
    rows = ready.select("rdid", "mate", "name", "seq", "qual", "yf").join(per, "rdid").join(mapped, ["rdid", "mate"], "left").join(firsts, ["rdid", "mate"], "left").join(counts, ["rdid", "mate"], "left")
    lone = mapped.where("rank = 1").groupBy("rdid").agg(F.max(F.struct("mate", "chrom_id", "pos", "fw")).alias("any"))
    rows = rows.join(lone, "rdid", "left").join(ref.select("chrom_id", "chrom"), "chrom_id", "left")
    names = ref.select(F.col("chrom_id").alias("_oc"), F.col("chrom").alias("other_chrom"))
    rows = rows.withColumn("_oc", F.coalesce("other.chrom_id", F.when(F.col("any.mate") != F.col("mate"), F.col("any.chrom_id")))).join(names, "_oc", "left")
    is_mapped = F.col("chrom").isNotNull()
    mate_mapped = F.col("other").isNotNull() | (F.col("any").isNotNull() & (F.col("any.mate") != F.col("mate")))
    concordant, discordant = F.col("category") == "concordant", F.col("category") == "discordant"
    other_pos = F.coalesce("other.pos", F.when(F.col("any.mate") != F.col("mate"), F.col("any.pos")))
    other_fw = F.coalesce("other.fw", F.when(F.col("any.mate") != F.col("mate"), F.col("any.fw")), F.lit(True))
    xm, xo, xg, nm = counted_edits(F.col("edits"))
    n = F.length("seq")
    quality = mapq(F.col("best"), F.col("second"), n * (2 if o.local and not o.scoring.match else o.scoring.match), o.least_score.whole(n))
    tag = tags(
        AS=F.col("score"), ZS=F.when(is_mapped, F.col("second")), XN=F.when(is_mapped, F.lit(0)), XM=F.when(is_mapped, xm), XO=F.when(is_mapped, xo), XG=F.when(is_mapped, xg), NM=F.when(is_mapped, nm),
        YF=F.col("yf"), YT=pair_class_tag(F.col("paired"), concordant, discordant), YS=F.col("other.score"), MD=F.col("md"), XS=F.when(is_mapped, strand_tag(F.col("splice_strand"), F.col("fw"), F.col("mate"), o.rna_strandness)),
        NH=F.col("nh"), Zs=F.when(is_mapped, known_variant_tag(F.col("edits"))),
    )
    forward = F.coalesce("fw", F.lit(True))
    # from end to end of the fragment, clipped bases included
    outer = lambda start, end, cigar: (start - clip(cigar), end + 1 + clip(cigar, False))
    own_chrom = F.coalesce("chrom", F.when(mate_mapped, F.col("other_chrom")))
    from ..functions.seq import chrom_name

    spell = (lambda c: chrom_name(c, o.remove_chrname, o.add_chrname)) if o.remove_chrname or o.add_chrname else (lambda c: c)
    return rows.select(
        "rdid",
        "mate",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        clean_name("name", pair=False).alias("qname"),
        flag(F.col("paired"), concordant, is_mapped, F.col("paired") & mate_mapped, forward, other_fw, F.col("mate"), F.coalesce(F.col("rank") > 1, F.lit(False))).alias("flag"),
        spell(own_chrom).alias("chrom"),
        F.coalesce("pos", F.when(mate_mapped, other_pos)).alias("pos"),
        F.when(is_mapped, quality).otherwise(0).alias("mapq"),
        F.when(is_mapped, F.col("cigar")).alias("cigar"),
        F.when(F.col("paired"), spell(F.when(mate_mapped, F.col("other_chrom")).otherwise(F.col("chrom")))).alias("mate_chrom"),
        F.when(F.col("paired"), F.when(mate_mapped, other_pos).otherwise(F.col("pos"))).alias("mate_pos"),
        F.when(is_mapped & F.col("other").isNotNull() & (F.col("other.chrom_id") == F.col("chrom_id")), template_length(*outer(F.col("pos"), F.col("end"), F.col("cigar")), *outer(F.col("other.pos"), F.col("other.end"), F.col("other.cigar")), F.col("mate") == 1)).otherwise(0).alias("tlen"),
        F.when(forward, F.col("seq")).otherwise(reverse_complement("seq")).alias("seq"),
        F.when(forward, F.col("qual")).otherwise(F.reverse("qual")).alias("qual"),
        tag.alias("tags"),
        "category",
        "paired",
        F.col("n_pairs").alias("n"),
        "n1",
        "n2",
        "n0",
        is_mapped.alias("mapped"),
        "edits",
    )


def counters(records: DataFrame) -> DataFrame:
    """One row for each read or pair, as operators.metrics.reporting takes them."""
    per = records.groupBy("rdid").agg(F.max("paired").alias("paired"), F.max("category").alias("category"), F.max(F.when(F.col("paired"), F.col("n")).otherwise(F.col("n0"))).alias("n"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    return per


__all__ = ["EDIT", "align", "candidates", "counters", "diagonals", "extend_candidates", "filter_tag", "partial_hits", "prepare", "report", "seed_hits", "chained_candidates"]
