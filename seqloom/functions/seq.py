"""Columns over base strings: complement, codes, trimming, k-mers, minimizer hashes, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of the read codes 0 to 4.
CODES = "ACGTN"
_IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    """Letters other than A, C, G and T stay as they are."""
    return F.translate(F.reverse(col(seq)), "ACGTacgt", "TGCAtgca")


def base_code(base: Column | str) -> Column:
    """0 to 3 for A, C, G, T (either case), 4 for all else; null stays null."""
    at = F.instr(F.lit(CODES[:4]), F.upper(col(base)))
    return F.when(col(base).isNull(), F.lit(None)).when((at > 0) & (F.length(col(base)) == 1), at - 1).otherwise(4).cast("int")


def code_base(code: Column | str) -> Column:
    return F.substring(F.lit(CODES), F.least(col(code), F.lit(4)) + 1, F.lit(1))


def iupac_mask(base: Column | str) -> Column:
    """Bit mask (A=1, C=2, G=4, T=8) of an IUPAC letter; 0 for other characters."""
    known = F.create_map(*(F.lit(x) for pair in _IUPAC.items() for x in pair))
    return F.coalesce(F.element_at(known, F.upper(col(base))), F.lit(0))


def text_to_bases(text: Column | str) -> Column:
    """Projection of prose to bases: letters a to z by their index modulo 4; all else is dropped."""
    # other ASCII characters are dropped by translate, so the regular expression finds little to replace
    others = "".join(c for c in map(chr, range(1, 128)) if not c.isalpha())
    letters = F.translate(F.lower(col(text)), "abcdefghijklmnopqrstuvwxyz" + others, ("ACGT" * 7)[:26])
    return F.regexp_replace(letters, "[^ACGT]+", "")


def trim(seq: Column | str, trim5: int | Column = 0, trim3: int | Column = 0) -> Column:
    """Cuts trim5 characters off the front and trim3 off the end; empty if nothing is left."""
    t5, t3 = (x if isinstance(x, Column) else F.lit(x) for x in (trim5, trim3))
    return F.substring(col(seq), t5 + 1, F.greatest(F.length(col(seq)) - t5 - t3, F.lit(0)))


def count_n(seq: Column | str) -> Column:
    """Characters that are not A, C, G or T."""
    return F.length(col(seq)) - F.length(F.regexp_replace(col(seq), "[^ACGTacgt]", ""))


def kmer_int(seq: Column | str) -> Column:
    """Two bits a base, first base highest; null if a letter is not A, C, G or T or there are more than 31."""
    digits = F.translate(F.upper(col(seq)), "ACGT", "0123")
    value = F.conv(digits, 4, 10).cast("decimal(20,0)").cast("long")
    return F.when(F.upper(col(seq)).rlike("^[ACGT]{1,31}$"), value)


def bound(value: Column, use) -> Column:
    """use(value), the value computed once however often use takes it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def minimizer_hash(kmer: Column | str, bits: int) -> Column:
    """Invertible mix of a k-mer number of so many bits (62 at most): multiplications by odd numbers and shifted exclusive ors, kept within the bits."""
    mask = F.lit((1 << bits) - 1)
    half = max(1, bits // 2)

    def multiplied(x: Column, odd: int) -> Column:
        # the product is taken in two halves, so that it never leaves 64 bits
        low, high = x.bitwiseAND(F.lit((1 << half) - 1)), F.shiftrightunsigned(x, half)
        part = (high * F.lit(odd)).bitwiseAND(F.lit((1 << (bits - half)) - 1))
        return (F.shiftleft(part, half) + low * F.lit(odd)).bitwiseAND(mask)

    times = lambda odd: lambda y: multiplied(y, odd)
    x = col(kmer).bitwiseAND(mask)
    for odd in (0x2545F, 0x9E37B):
        x = bound(bound(x, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, half))), times(odd))
    return bound(x, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, half)))


def windows(seq: Column | str, k: int, step: int = 1) -> Column:
    """Array of (pos, kmer) of the windows of k characters, every step characters; empty for shorter strings."""
    s = col(seq)
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(0), F.length(s) - k, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.substring(s, i + 1, F.lit(k)).alias("kmer")))


#: Letters that are cut out at a time, first to last: a cut walks its string from the start, so windows are taken from short pieces of longer pieces, and a long sequence costs in proportion to its length.
BLOCKS = (8192, 64)


def window_rows(df: DataFrame, keep: list[str], seq: Column | str, k: int, step: int = 1) -> DataFrame:
    """keep, pos and kmer of the windows of k characters, every step characters, one row each."""
    pieces = df.select(*keep, F.lit(0).alias("_at"), col(seq).alias("_s"))
    for block in BLOCKS:
        starts = F.when(F.length("_s") >= k, F.sequence(F.lit(0), F.length("_s") - k, F.lit(block)))
        cut = pieces.select(*keep, "_at", "_s", F.explode(starts).alias("_b"))
        pieces = cut.select(*keep, (F.col("_at") + F.col("_b")).alias("_at"), F.substring("_s", F.col("_b") + 1, F.lit(block + k - 1)).alias("_s"))
    first = F.pmod(-F.col("_at"), F.lit(step))
    starts = F.when(F.length("_s") >= first + k, F.sequence(first, F.length("_s") - k, F.lit(step))) if step > 1 else F.sequence(F.lit(0), F.length("_s") - k)
    places = pieces.select(*keep, "_at", "_s", F.explode(starts).alias("_i"))
    return places.select(*keep, (F.col("_at") + F.col("_i")).cast("long").alias("pos"), F.substring("_s", F.col("_i") + 1, F.lit(k)).alias("kmer"))


def clean_name(name: Column | str, pair: bool = False, truncate: bool = False) -> Column:
    """Read name up to the first white space, without /1 or /2 for pairs, at most 255 characters on demand."""
    out = F.regexp_extract(col(name), r"^(\S*)", 1)
    if pair:
        out = F.regexp_replace(out, r"/[12]$", "")
    return F.substring(out, 1, 255) if truncate else out


def read_seed(seq: Column, qual: Column, name: Column, seed: int = 0) -> Column:
    """Number that depends on the read alone, for choices that must not depend on the order of work."""
    return F.xxhash64(F.lit(seed), F.coalesce(seq, F.lit("")), F.coalesce(qual, F.lit("")), F.coalesce(name, F.lit("")))


def canonical_junction(donor: Column, acceptor: Column) -> Column:
    """Whether the intron's first two and last two bases are GT-AG on either strand."""
    return ((donor == "GT") & (acceptor == "AG")) | ((donor == "CT") & (acceptor == "AC"))


def chrom_name(name: Column | str, remove: bool = False, add: bool = False) -> Column:
    """Strips or adds the prefix chr; both together is an error."""
    if remove and add:
        raise ValueError("remove and add cannot both be asked for")
    if remove:
        return F.regexp_replace(col(name), "^chr", "")
    return F.concat(F.lit("chr"), col(name)) if add else col(name)


def collapse_cg(seq: Column | str) -> Column:
    """CG to TG, as before repeat discovery in converted genomes."""
    return F.replace(col(seq), F.lit("CG"), F.lit("TG"))
