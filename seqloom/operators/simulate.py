"""Seeded read simulator with truth, and its validator."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cigar import EDIT, build_cigar, build_md, edits_of, reference_side
from ..functions.seq import reverse_complement

#: Fixed value of the expression model.
FLUX = 9500.0


def expression_profile(n: int, constant: bool = False) -> list[float]:
    """Shares of n transcripts by rank: x**-0.6 * exp(x / a * (x / a)**2) with a = FLUX, or all equal."""
    weights = [1.0 if constant else x**-0.6 * math.exp(x / FLUX * (x / FLUX) ** 2) for x in range(1, n + 1)]
    total = sum(weights)
    return [w / total for w in weights]


def dna_profile(ref: DataFrame) -> DataFrame:
    """(chrom_id, share): a chromosome's share of all bases."""
    total = ref.agg(F.sum(F.length("seq")).alias("_t"))
    return ref.crossJoin(F.broadcast(total)).select("chrom_id", (F.length("seq") / F.col("_t")).alias("share"))


def pick_variants(vs: list[dict], left: int, right: int) -> list[dict]:
    """Variants inside [left, right), left to right, that do not overlap."""
    out: list[dict] = []
    for v in sorted(vs, key=lambda v: v["pos"]):
        end = v["pos"] + (int(v["data"]) if v["type"] == "deletion" else 1)
        if v["pos"] > left and end < right and (not out or v["pos"] > out[-1]["_end"]):
            out.append(v | {"_end": end})
    return out


def truth(bases: str, offset: int, pos: int, blocks: list[tuple[int, int]], vs: list[dict], errors: dict[int, str], length: int) -> tuple[str, list[dict]]:
    """Read of length bases from transcript blocks (start, end) of bases (which begin at offset), beginning at pos, with variants and errors put in, and its edits."""
    read, edits, at = [], [], pos
    block = next(k for k, (a, b) in enumerate(blocks) if a <= pos < b)
    known = {v["pos"]: v for v in vs}
    while len(read) < length:
        if at >= blocks[block][1]:
            if block + 1 == len(blocks):
                break
            gap = blocks[block + 1][0] - at
            edits.append({"pos": len(read), "type": "spl", "ref": "", "read": "", "length": gap, "snp": None})
            block, at = block + 1, blocks[block + 1][0]
        v = known.pop(at, None)
        if v and v["type"] == "deletion" and read and at + int(v["data"]) < blocks[block][1]:
            n = int(v["data"])
            edits.append({"pos": len(read), "type": "del", "ref": bases[at - offset : at - offset + n], "read": "", "length": n, "snp": v["id"]})
            at += n
            continue
        if v and v["type"] == "insertion" and read and len(read) + len(v["data"]) < length:
            edits.append({"pos": len(read), "type": "ins", "ref": "", "read": v["data"], "length": len(v["data"]), "snp": v["id"]})
            read += list(v["data"])
            continue
        base = bases[at - offset]
        got, snp = (v["data"], v["id"]) if v and v["type"] == "single" else (base, None)
        if len(read) in errors and errors[len(read)] != got and not snp:
            got = errors[len(read)]
        if got != base:
            edits.append({"pos": len(read), "type": "mm", "ref": base, "read": got, "length": 1, "snp": snp})
        read.append(got)
        at += 1
    return "".join(read), edits


def simulate(transcripts: DataFrame, n: int, read_length: int = 100, fragment: int = 250, paired: bool = True, error_rate: float = 0.0, snp_share: float = 1.0, seed: int = 0) -> DataFrame:
    """Reads with truth: (rdid, mate, name, chrom, pos, fw, seq, cigar, md, edits, transcript).

    transcripts: (transcript, chrom, bases, offset, blocks, variants, share), blocks the exons as
    (start, end) with open ends, or one block for plain sequence. Each gets its share of n fragments; the
    second mate lies on the reverse strand. The same seed gives the same reads.
    """
    edit = EDIT

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                blocks = [(int(b["start"]), int(b["end"])) for b in row.blocks]
                vs = [dict(v) if isinstance(v, dict) else v.asDict() for v in (row.variants if row.variants is not None else [])]
                size = sum(b - a for a, b in blocks)
                if size < max(read_length, fragment if paired else read_length):
                    continue
                rng = random.Random(f"{seed}:{row.transcript}")
                for k in range(round(n * row.share)):
                    start = rng.randrange(size - (fragment if paired else read_length) + 1)
                    used = pick_variants([v for v in vs if rng.random() < snp_share], blocks[0][0], blocks[-1][1])
                    for mate, begin in ((1, start), (2, start + fragment - read_length)) if paired else ((0, start),):
                        left = begin
                        for a, b in blocks:
                            if left < b - a:
                                pos = a + left
                                break
                            left -= b - a
                        wrong = {i: rng.choice("ACGT") for i in range(read_length) if rng.random() < error_rate}
                        read, edits = truth(row.bases, int(row.offset), pos, blocks, used, wrong, read_length)
                        out.append((f"{row.transcript}_{k}", mate, row.chrom, pos, mate != 2, read, build_cigar(len(read), edits), build_md(len(read), edits), edits, row.transcript))
            yield pd.DataFrame(out, columns=["name", "mate", "chrom", "pos", "fw", "aligned", "cigar", "md", "edits", "transcript"])

    made = transcripts.mapInPandas(run, f"name string, mate int, chrom string, pos long, fw boolean, aligned string, cigar string, md string, edits array<{edit}>, transcript string")
    return made.withColumn("seq", F.when(F.col("fw"), F.col("aligned")).otherwise(reverse_complement("aligned"))).withColumn("rdid", F.shiftrightunsigned(F.xxhash64("name"), 1))


def expected_reference(read: str, cigar: str, md: str) -> str:
    """Reference bases that a record claims."""
    return reference_side(read, edits_of(read, cigar, md))


def validate(records: DataFrame, ref: DataFrame) -> DataFrame:
    """Adds ok: whether the record (chrom, pos, aligned, cigar, md) spells the reference."""
    claimed = F.pandas_udf(lambda r, c, m: pd.Series([expected_reference(*x) for x in zip(r, c, m, strict=True)]), "string")
    j = records.join(ref.select("chrom", F.col("seq").alias("_ref")), "chrom")
    from ..functions.cigar import cigar_ops

    ops = cigar_ops(F.col("cigar"))
    start = F.struct(F.col("pos").cast("int").alias("at"), F.lit("").alias("out"))
    piece = lambda acc, x: F.struct(
        F.when(x["op"].isin("M", "D", "N", "=", "X"), acc["at"] + x["len"]).otherwise(acc["at"]).alias("at"),
        F.when(x["op"].isin("M", "D", "=", "X"), F.concat(acc["out"], F.substring("_ref", acc["at"] + 1, x["len"]))).otherwise(acc["out"]).alias("out"),
    )
    real = F.aggregate(ops, start, piece, lambda acc: acc["out"])
    return j.withColumn("ok", claimed("aligned", "cigar", "md") == real).drop("_ref")
