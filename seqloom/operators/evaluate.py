"""Comparison of alignments with truth, and sets of reads and junctions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import EDIT, build_cigar, build_md, compose, edit_rows, invert
from ..functions.seq import canonical_junction
from .intervals import overlap_join


def split_mapped(reads: DataFrame, mapped: DataFrame, key: str = "rdid") -> tuple[DataFrame, DataFrame]:
    """Reads that are in mapped, and those that are not."""
    ids = mapped.select(key).distinct()
    return reads.join(ids, key, "left_semi"), reads.join(ids, key, "left_anti")


def junction_matches(junctions: DataFrame, known: DataFrame, slack: int = 5) -> DataFrame:
    """Adds known_left and known_right: the nearest known junction (chrom, left, right) whose ends are both shifted by the same number of bases, slack at most."""
    a = junctions.withColumn("_id", F.monotonically_increasing_id()).withColumn("l_start", F.col("left")).withColumn("l_end", F.col("left"))
    b = known.select("chrom", F.col("left").alias("known_left"), F.col("right").alias("known_right")).withColumn("r_start", F.col("known_left")).withColumn("r_end", F.col("known_left"))
    pairs = overlap_join(a, b, ["chrom"], 1024, reach=slack).where("left - known_left = right - known_right")
    best = pairs.groupBy("_id").agg(F.min(F.struct(F.abs(F.col("left") - F.col("known_left")).alias("d"), "known_left", "known_right")).alias("m"))
    return a.drop("l_start", "l_end").join(best, "_id", "left").withColumn("known_left", F.col("m.known_left")).withColumn("known_right", F.col("m.known_right")).drop("_id", "m")


def is_canonical(seq: Column, left: Column, right: Column) -> Column:
    """Whether the intron between left and right of a chromosome sequence has canonical ends."""
    return canonical_junction(F.substring(seq, left.cast("int") + 2, F.lit(2)), F.substring(seq, right.cast("int") - 1, F.lit(2)))


def distinct_junctions(junctions: DataFrame, slack: int = 10) -> DataFrame:
    """Junctions (chrom, left, right) less those that are an equal shift, slack bases at most, of one that stays; those of one length are looked at in order, and a kept one hides what follows it within slack."""
    rows = junctions.select("chrom", "left", "right").distinct().withColumn("size", F.col("right") - F.col("left"))
    w = Window.partitionBy("chrom", "size").orderBy("left")
    apart = F.coalesce(F.col("left") - F.lag("left").over(w) > slack, F.lit(True)).cast("int")
    island = rows.withColumn("_new", apart).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # within an island of close neighbours the kept ones are picked greedily
    picked = F.aggregate(
        F.array_sort(F.collect_list("left")),
        F.array().cast("array<bigint>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > slack), F.concat(acc, F.array(x))).otherwise(acc),
    )
    kept = island.groupBy("chrom", "size", "_i").agg(picked.alias("l"))
    return kept.select("chrom", F.explode("l").alias("left"), "size").select("chrom", "left", (F.col("left") + F.col("size")).alias("right"))


def mapping_cost(found: DataFrame, truth: DataFrame, slack: int = 0) -> DataFrame:
    """One row of counters of found (name, mate, chrom, pos, cigar, nm) against truth (name, mate, chrom, pos, cigar)."""
    t = truth.select("name", "mate", F.col("chrom").alias("t_chrom"), F.col("pos").alias("t_pos"), F.col("cigar").alias("t_cigar"))
    per = found.groupBy("name", "mate").agg(F.count("*").alias("n"), F.collect_list(F.struct("chrom", "pos", "cigar", "nm")).alias("hits"))
    j = t.join(per, ["name", "mate"], "left")
    right = F.exists("hits", lambda h: (h["chrom"] == F.col("t_chrom")) & (F.abs(h["pos"] - F.col("t_pos")) <= slack))
    exact = F.exists("hits", lambda h: (h["chrom"] == F.col("t_chrom")) & (h["pos"] == F.col("t_pos")) & (h["cigar"] == F.col("t_cigar")))
    least = F.array_min(F.transform("hits", lambda h: h["nm"]))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return j.agg(
        F.count("*").alias("total"),
        count(F.col("n") > 0).alias("mapped"),
        count(F.col("n") == 1).alias("unique"),
        F.count_if(F.col("n").isNull()).alias("unmapped"),
        count(right).alias("correct"),
        count(exact).alias("exact"),
        count((F.col("n") == 1) & right).alias("unique_correct"),
        *(count(least == k).alias(f"nm_{k}") for k in range(4)),
        count(least > 3).alias("nm_more"),
    )


def pair_cost(found: DataFrame, truth: DataFrame, most: int = 1000) -> DataFrame:
    """One row of counters of pairs found (name, chrom, pos1, pos2) against truth (name, chrom, pos1, pos2): both mates right, and concordant."""
    t = truth.select("name", F.col("chrom").alias("t_chrom"), F.col("pos1").alias("t1"), F.col("pos2").alias("t2"))
    per = found.groupBy("name").agg(F.count("*").alias("n"), F.collect_list(F.struct("chrom", "pos1", "pos2")).alias("hits"))
    j = t.join(per, "name", "left")
    right = F.exists("hits", lambda h: (h["chrom"] == F.col("t_chrom")) & (h["pos1"] == F.col("t1")) & (h["pos2"] == F.col("t2")))
    near = F.exists("hits", lambda h: F.abs(h["pos1"] - h["pos2"]) <= most)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return j.agg(F.count("*").alias("total"), count(F.col("n") > 0).alias("mapped"), count(F.col("n") == 1).alias("unique"), F.count_if(F.col("n").isNull()).alias("unmapped"), count(right).alias("correct"), count(near).alias("concordant"))


def composed_records(records: DataFrame, copies: DataFrame) -> DataFrame:
    """Records on a repeat's consensus as records on its copies: records' columns, chrom_id, pos, fw, seq, cigar, md and edits of each record on each copy.

    records: rep_id, pos, seq, edits (on the consensus). copies: rep_id, consensus, chrom_id, start, span
    (bases of the copy), fw, copy_edits (of the consensus on the copy's own strand). The edits of both
    are composed; on reverse copies the read is turned round.
    """
    carried = [f for f in records.schema if f.name not in ("pos", "seq", "edits")]
    names = [f.name for f in carried]
    held = copies.select("rep_id", "consensus", "chrom_id", F.col("start").alias("_start"), F.col("span").alias("_span"), F.col("fw").alias("_fw"), "copy_edits")
    j = records.join(held, "rep_id").select(*names, "pos", "seq", "edits", "consensus", "chrom_id", "_start", "_span", "_fw", "copy_edits")
    turned = str.maketrans("ACGT", "TGCA")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                x = dict(zip(frame.columns, row, strict=True))
                seq = x["seq"]
                pos, edits = compose(x["consensus"], seq, int(x["pos"]), edit_rows(x["edits"]), edit_rows(x["copy_edits"]))
                if not x["_fw"]:
                    covered = len(seq) + sum(e["length"] if e["type"] == "del" else -e["length"] if e["type"] == "ins" else 0 for e in edits)
                    pos = int(x["_span"]) - pos - covered
                    edits = [e | {"ref": e["ref"].translate(turned)[::-1], "read": e["read"].translate(turned)[::-1]} for e in invert(edits, len(seq))]
                    seq = seq.translate(turned)[::-1]
                out.append((*(x[c] for c in names), x["chrom_id"], int(x["_start"]) + pos, bool(x["_fw"]), seq, build_cigar(len(seq), edits), build_md(len(seq), edits), edits))
            yield pd.DataFrame(out, columns=[*names, "chrom_id", "pos", "fw", "seq", "cigar", "md", "edits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + f", chrom_id {copies.schema['chrom_id'].dataType.simpleString()}, pos long, fw boolean, seq string, cigar string, md string, edits array<{EDIT}>"
    return j.mapInPandas(run, schema)


def genome_records(records: DataFrame, repeats: DataFrame) -> DataFrame:
    """Records on repeats (rep_id, pos, len, ...) as records on the genome."""
    from .repeats import expand

    return expand(records, repeats)
