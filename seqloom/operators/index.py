"""The k-mer index: a table of (kmer, chrom_id, pos, tile_id) in place of a suffix structure.

It answers what ranges of a suffix index answer: a lookup is an equality join, the positions are
stored with the key, and tiles of the reference restrict local searches. Variants are covered by
windows over every combination of up to ``max_alternatives`` of the variants that they touch.
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import kmer_int, minimizer_hash, reverse_complement, window_rows

TILE, OVERLAP = 57344, 1024


def kmer_index(ref: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """(kmer, chrom_id, pos, tile_id) of every window of k known bases of ref (chrom_id, seq)."""
    rows = window_rows(ref, ["chrom_id"], "seq", k).select("kmer", "chrom_id", "pos")
    return rows.where(F.col("kmer").rlike("^[ACGT]+$")).withColumn("tile_id", F.floor(F.col("pos") / (tile - OVERLAP)))


def tiles(ref: DataFrame, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """(chrom_id, tile_id, start, seq): pieces of tile bases that overlap."""
    step = tile - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(step))
    rows = ref.select("chrom_id", "seq", F.posexplode(starts).alias("tile_id", "start"))
    return rows.select("chrom_id", "tile_id", "start", F.substring("seq", F.col("start") + 1, F.lit(tile)).alias("seq"))


#: Bases up to which pieces of a reference may be broadcast (a byte each, overlaps apart).
MAX_BROADCAST_BASES = 64_000_000


def total_bases(ref: DataFrame) -> int:
    return ref.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]


def bases_at(places: DataFrame, ref: DataFrame, start: str, length: str, out: str, longest: int = OVERLAP, bases: int | None = None) -> DataFrame:
    """Adds out: the reference bases of places (chrom_id, start, length, ...) from start on, fewer where the sequence ends; longest bounds the lengths.

    The join is on tiles of the reference, so a row gets a piece of TILE bases and never a chromosome.
    The tiles are broadcast if the reference has MAX_BROADCAST_BASES at most (bases, if it was counted
    before). Places that begin before 0 or whose length is not positive get an empty string.
    """
    step = max(TILE - OVERLAP, longest)
    pieces = tiles(ref, step + longest, longest).select(F.col("chrom_id").alias("_tile_chrom"), F.col("tile_id").alias("_tile_id"), F.col("start").alias("_tile_start"), F.col("seq").alias("_tile_seq"))
    if (total_bases(ref) if bases is None else bases) <= MAX_BROADCAST_BASES:
        pieces = F.broadcast(pieces)
    tile = F.greatest(F.floor(F.col(start) / step), F.lit(0))
    inside = (F.col(start) >= 0) & (F.col(length) > 0)
    j = places.withColumn("_tile", tile).join(pieces, (F.col("chrom_id") == F.col("_tile_chrom")) & (F.col("_tile") == F.col("_tile_id")), "left")
    cut = F.when(inside, F.substring("_tile_seq", (F.col(start) - F.col("_tile_start")).cast("int") + 1, F.col(length).cast("int")))
    return j.withColumn(out, F.coalesce(cut, F.lit(""))).drop("_tile", "_tile_chrom", "_tile_id", "_tile_start", "_tile_seq")


def lookup(queries: DataFrame, index: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Hits of queries (kmer, ...); k-mers with more than max_hits places are left out on the index side, before the join."""
    if max_hits is not None:
        common = index.groupBy("kmer").agg(F.count("*").alias("_n")).where(F.col("_n") > max_hits).select("kmer")
        index = index.join(common, "kmer", "left_anti")
    return queries.join(index, "kmer")


def positions(index: DataFrame) -> DataFrame:
    """(kmer, n, positions): all places of a k-mer in one row. For k-mers of bounded frequency; hot ones belong in the plain index."""
    return index.groupBy("kmer").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("chrom_id", "pos"))).alias("positions"))


#: Windows of k-mers that are looked at in one row.
BLOCK = 64


def minimizers(seqs: DataFrame, k: int, w: int) -> DataFrame:
    """(id, kmer, pos) of the k-mer of least hash of each w neighbouring ones of seqs (id, seq); among equals the later one, each place once. k is 31 at most; windows with other letters than A, C, G, T are passed over.

    A sequence of fewer than w k-mers is one window. Sequences are cut into blocks of windows, and a
    block leaves out the place that the last window before it has picked, so nothing is shuffled and
    no task holds a sequence.
    """
    n = F.length("seq") - F.lit(k - 1)
    last = F.greatest(n - w, F.lit(0))
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(BLOCK)))
    # one window more in front tells what was picked before
    cut = seqs.select("id", "seq", last.alias("_last"), F.explode(starts).alias("_b")).withColumn("_from", F.greatest(F.col("_b") - 1, F.lit(0)))
    pieces = cut.select("id", "_b", "_from", F.least(F.col("_last"), F.col("_b") + BLOCK - 1).alias("_to"), F.substring("seq", F.col("_from") + 1, F.lit(BLOCK + w + k - 1)).alias("_s"))
    grams = F.transform(F.sequence(F.lit(0), F.length("_s") - k), lambda i: F.struct(F.substring("_s", i + 1, F.lit(k)).alias("kmer"), i.alias("i")))
    ranked = F.transform(grams, lambda g: F.when(g["kmer"].rlike("^[ACGT]*$"), F.struct(minimizer_hash(kmer_int(g["kmer"]), 2 * k).alias("h"), (-g["i"]).alias("back"), g["kmer"].alias("kmer"))))
    # exploded, so that each hash is taken once and not for every window
    pieces = pieces.select("id", "_b", "_from", "_to", F.explode(F.array(ranked)).alias("_g"))
    picked = F.transform(F.sequence(F.lit(0), F.col("_to") - F.col("_from")), lambda i: F.array_min(F.slice("_g", i + 1, F.lit(w))))
    pieces = pieces.select("_b", "_from", "id", F.explode(F.array(picked)).alias("_p"))
    before = F.when(F.col("_b") > 0, F.element_at("_p", 1)["back"])
    own = F.when(F.col("_b") > 0, F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0)))).otherwise(F.col("_p"))
    kept = F.filter(F.array_distinct(own), lambda x: x.isNotNull() & ~x["back"].eqNullSafe(before))
    return pieces.select("id", "_from", F.explode(kept).alias("m")).select("id", "m.kmer", (F.col("_from") - F.col("m.back")).cast("long").alias("pos"))


def minimizer_index(seqs: DataFrame, k: int = 31, w: int = 5) -> DataFrame:
    """(kmer, n, places) of all minimizers."""
    return minimizers(seqs, k, w).groupBy("kmer").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("id", "pos"))).alias("places"))


def is_repeat(seqs: DataFrame, repeats: DataFrame, k: int = 31, w: int = 5) -> DataFrame:
    """seqs (id, seq) of which a minimizer, on either strand, is in repeats (kmer)."""
    both = seqs.select("id", "seq").union(seqs.select("id", reverse_complement("seq").alias("seq")))
    keyed = both.select(F.struct("id", F.monotonically_increasing_id().alias("s")).alias("id"), "seq")
    found = minimizers(keyed, k, w).join(repeats.select("kmer").distinct(), "kmer", "left_semi").select(F.col("id.id").alias("id")).distinct()
    return seqs.join(found, "id", "left_semi")


def variant_windows(ref: DataFrame, variants: DataFrame, k: int, max_alternatives: int = 16) -> DataFrame:
    """(kmer, chrom_id, pos, alts, complete): windows of k bases that cross known variants (chrom_id, id, type, pos, data).

    Variants at most k apart form a site. Alleles are combined for each window of bases, so a site of
    any length gives every window that crosses up to max_alternatives combinations of the variants
    within reach of each other; windows with a single variant are always given. complete is false for
    the windows of a place whose variants have more combinations than that.
    """
    from .intervals import merge

    width = F.when(F.col("type") == "deletion", F.col("data").try_cast("long")).otherwise(F.lit(1))
    v = variants.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + width - 1)
    sites = merge(v, ["chrom_id"], gap=k, carried={"vs": F.sort_array(F.collect_list(F.struct("pos", "type", "data", "id")))})
    left = F.greatest(F.col("start") - k, F.lit(0))
    sites = sites.withColumn("left", left).withColumn("_n", F.col("end") - left + k + 1)
    longest = sites.agg(F.coalesce(F.max("_n"), F.lit(1))).first()[0]
    cut = bases_at(sites, ref, "left", "_n", "bases", longest=max(OVERLAP, int(longest))).select("chrom_id", "left", "bases", "vs")

    def run(frames):
        for frame in frames:
            out = []
            for chrom_id, left, bases, vs in zip(frame.chrom_id, frame["left"], frame.bases, frame.vs, strict=True):
                vs = [dict(x) if isinstance(x, dict) else x.asDict() for x in vs]
                chosen, complete = allele_sets(vs, k, max_alternatives)
                for alleles in chosen:
                    text, places = apply_variants(bases, left, alleles)
                    low, high = max(0, places[0][0] - k + 1), min(len(text) - k, places[-1][1] - 1)
                    for i in range(low, high + 1):
                        used = [x["id"] for x, (a, b) in zip(alleles, places, strict=True) if a < i + k and b > i]
                        # a window that crosses only some of them belongs to the smaller combination
                        if len(used) == len(alleles) and set(text[i : i + k]) <= set("ACGT"):
                            out.append((text[i : i + k], chrom_id, _origin(i, left, alleles, places), used, complete))
            yield pd.DataFrame(out, columns=["kmer", "chrom_id", "pos", "alts", "complete"])

    return cut.mapInPandas(run, "kmer string, chrom_id long, pos long, alts array<string>, complete boolean")


def allele_sets(vs: list[dict], reach: int, most: int) -> tuple[list[list[dict]], bool]:
    """Combinations of one variant or more of which no two touch the same base and the last begins less than reach bases after the first ends, and whether these are all.

    All single variants, then pairs, and so on; of each first variant at most ``most`` combinations.
    """
    vs = sorted(vs, key=lambda x: x["pos"])
    out, complete = [], True
    for at, first in enumerate(vs):
        level, found = [([first], at)], 0
        while level:
            after = []
            for alleles, last in level:
                if found >= most:
                    complete = False
                    break
                out.append(alleles)
                found += 1
                for n in range(last + 1, len(vs)):
                    if vs[n]["pos"] - first["pos"] - (int(first["data"]) if first["type"] == "deletion" else 0) >= reach:
                        break
                    if _after(alleles[-1], vs[n]):
                        after.append(([*alleles, vs[n]], n))
            level = after if found < most else []
            complete = complete and not (after and not level)
    return out, complete


def _after(a: dict, b: dict) -> bool:
    return b["pos"] > a["pos"] + (int(a["data"]) if a["type"] == "deletion" else 0)


def apply_variants(bases: str, left: int, alleles: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """bases, which start at left, with the alleles put in, and where each stands in the result."""
    out, places, at, size = [], [], left, 0
    for x in alleles:
        keep = bases[at - left : x["pos"] - left]
        size += len(keep)
        out.append(keep)
        if x["type"] == "single":
            out.append(x["data"])
            places.append((size, size + 1))
            size, at = size + 1, x["pos"] + 1
        elif x["type"] == "insertion":
            out.append(x["data"])
            places.append((size, size + len(x["data"])))
            size, at = size + len(x["data"]), x["pos"]
        else:
            places.append((size - 1, size + 1))
            at = x["pos"] + int(x["data"])
    out.append(bases[at - left :])
    return "".join(out), places


def _origin(i: int, left: int, alleles: list[dict], places: list[tuple[int, int]]) -> int:
    """Reference place of the i-th base of the changed text (inserted bases: the place before which they stand)."""
    shift = 0
    for x, (a, b) in zip(alleles, places, strict=True):
        if x["type"] == "insertion" and i >= a:
            shift -= min(i, b) - a
        elif x["type"] == "deletion" and i > a:
            shift += int(x["data"])
    return left + i + shift


def graph(ref: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label, value) and edges (from, to) of the graph of a reference with its variants: one node a base, bubbles for variants."""
    base = ref.select("chrom_id", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "label"))
    node = lambda *c: F.concat_ws(":", *c)
    nodes = base.select(node("chrom_id", "pos").alias("node"), "label", F.col("pos").cast("long").alias("value"))
    edges = base.select(node("chrom_id", "pos").alias("from"), node("chrom_id", F.col("pos") + 1).alias("to"))
    letters = F.when(F.col("type") == "deletion", F.array().cast("array<string>")).otherwise(F.filter(F.split("data", ""), lambda c: c != ""))
    v = variants.withColumn("l", letters)
    alt = v.select("chrom_id", "id", "pos", F.posexplode("l").alias("k", "label"))
    nodes = nodes.union(alt.select(node("chrom_id", "id", "k").alias("node"), "label", F.col("pos").cast("long").alias("value")))
    before = node("chrom_id", F.col("pos") - 1)
    after = F.when(F.col("type") == "single", F.col("pos") + 1).when(F.col("type") == "deletion", F.col("pos") + F.col("data").try_cast("long")).otherwise(F.col("pos"))
    first = F.when(F.size("l") > 0, node("chrom_id", "id", F.lit(0))).otherwise(node("chrom_id", after))
    edges = edges.union(v.select(before.alias("from"), first.alias("to"))).union(v.where("size(l) > 0").select(node("chrom_id", "id", F.size("l") - 1).alias("from"), node("chrom_id", after).alias("to")))
    edges = edges.union(alt.where("k > 0").select(node("chrom_id", "id", F.col("k") - 1).alias("from"), node("chrom_id", "id", "k").alias("to")))
    return nodes, edges.join(nodes.select(F.col("node").alias("to")), "to", "left_semi").join(nodes.select(F.col("node").alias("from")), "from", "left_semi").select("from", "to")


def ranked_suffixes(ref: DataFrame, prefix: int) -> DataFrame:
    """(chrom_id, pos, suffix, rank): places ordered by the first prefix letters of their suffix; equal prefixes share a rank. Ranks come from counts of prefixes, so no task sorts all suffixes."""
    s = ref.select("chrom_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos")).select("chrom_id", "pos", F.substring("seq", F.col("pos") + 1, F.lit(prefix)).alias("suffix"))
    lead = F.substring("suffix", 1, 4)
    counts = s.groupBy("suffix").agg(F.count("*").alias("n")).withColumn("lead", lead)
    inside = Window.partitionBy("lead").orderBy("suffix").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("lead").agg(F.sum("n").alias("total"))
    before = blocks.select("lead", F.coalesce(F.sum("total").over(Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranks = counts.join(before, "lead").select("suffix", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("rank"))
    return s.join(ranks, "suffix").select("chrom_id", "pos", "suffix", "rank")


def write_index(path: str, ref: DataFrame, index: DataFrame, **tables: DataFrame) -> None:
    """Parquet tables under path: ref, kmers (by chromosome), and others by name (alts, haplotypes, splice_sites, exons, repeats)."""
    ref.write.mode("overwrite").parquet(f"{path}/ref")
    index.write.mode("overwrite").partitionBy("chrom_id").parquet(f"{path}/kmers")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("ref", "kmers", *names)}
