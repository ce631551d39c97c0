"""SAM flags and tags as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(paired: Column, proper: Column, mapped: Column, mate_mapped: Column, forward: Column, mate_forward: Column, mate: Column, secondary: Column) -> Column:
    """Sum of the bits 1 to 256; mate is 0 for unpaired reads, else 1 or 2."""
    bit = lambda c, n: F.when(c, F.lit(n)).otherwise(0)
    return (
        bit(paired, 1)
        + bit(paired & proper & mapped, 2)
        + bit(~mapped, 4)
        + bit(paired & ~mate_mapped, 8)
        + bit(mapped & ~forward, 16)
        + bit(paired & mate_mapped & ~mate_forward, 32)
        + bit(mate == 1, 64)
        + bit(mate == 2, 128)
        + bit(mapped & secondary, 256)
    ).cast("int")


def pair_class_tag(paired: Column, concordant: Column, discordant: Column) -> Column:
    """YT: UU unpaired, CP concordant, DP discordant, UP pair that did not align as one."""
    return F.when(~paired, "UU").when(concordant, "CP").when(discordant, "DP").otherwise("UP")


def filter_tag(length_ok: Column, n_ok: Column, score_ok: Column, qc_ok: Column) -> Column:
    """YF: why a read was not aligned, or null."""
    return F.when(~length_ok, "LN").when(~n_ok, "NS").when(~score_ok, "SC").when(~qc_ok, "QC")


def strand_tag(splice_strand: Column, forward: Column, mate: Column, strandness: str = "") -> Column:
    """XS:A: the strand of the junctions, or, with a stranded library (F, R, FR, RF), of the read."""
    if not strandness:
        return F.when(splice_strand.isin("+", "-"), splice_strand)
    if strandness not in ("F", "R", "FR", "RF"):
        raise ValueError(f"no library type {strandness!r}")
    first = strandness[0] == "F"
    sense = F.when(mate == 2, forward != F.lit(first)).otherwise(forward == F.lit(first))
    return F.when(sense, "+").otherwise("-")


def template_length(start: Column, end: Column, mate_start: Column, mate_end: Column, first: Column, intron: Column | None = None) -> Column:
    """Signed length of the fragment from end to end (ends exclusive), positive for the upstream mate; an intron between mates over 100 bases apart is taken off."""
    low, high = F.least(start, mate_start), F.greatest(end, mate_end)
    apart = F.greatest(start, mate_start) - F.least(end, mate_end)
    size = high - low - (F.when(apart > 100, F.coalesce(intron, F.lit(0))).otherwise(0) if intron is not None else F.lit(0))
    upstream = (start < mate_start) | ((start == mate_start) & first)
    return F.when(upstream, size).otherwise(-size)


def known_variant_tag(edits: Column) -> Column:
    """Zs: pos|type|id for each edit that is a known variant, pos counted from the one before; null if there is none."""
    known = F.filter(edits, lambda e: e["snp"].isNotNull())
    kind = lambda e: F.when(e["type"] == "mm", "S").when(e["type"] == "del", "D").otherwise("I")
    width = lambda e: F.when(e["type"] == "ins", e["length"]).when(e["type"] == "mm", F.lit(1)).otherwise(F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    told = F.aggregate(
        known,
        start,
        lambda acc, e: F.struct((e["pos"] + width(e)).cast("int").alias("at"), F.concat(acc["out"], F.array(F.concat_ws("|", (e["pos"] - acc["at"]).cast("string"), kind(e), e["snp"]))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(F.size(known) > 0, F.array_join(told, ","))


def counted_edits(edits: Column) -> tuple[Column, Column, Column, Column]:
    """XM, XO, XG, NM; edits of known variants are not counted."""
    own = F.filter(edits, lambda e: e["snp"].isNull() & (e["type"] != "spl"))
    mm = F.size(F.filter(own, lambda e: e["type"] == "mm"))
    gaps = F.filter(own, lambda e: e["type"] != "mm")
    bases = F.aggregate(gaps, F.lit(0), lambda a, e: a + e["length"])
    return mm, F.size(gaps), bases, mm + bases
