"""Score columns: qualities, penalties, gap and intron limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import Scoring


def decode_quality(char: Column, scale: str = "phred33") -> Column:
    """Phred quality of an ASCII quality character; an error where it is below the scale."""
    if scale == "phred33":
        q = F.ascii(char) - 33
    elif scale == "phred64":
        q = F.ascii(char) - 64
    elif scale == "solexa":
        s = (F.ascii(char) - 64).cast("double")
        return F.when(s < -5, F.raise_error(F.lit("quality below the scale"))).otherwise((F.lit(10.0) * F.log10(F.lit(1.0) + F.pow(F.lit(10.0), s / 10.0)) + 0.5).cast("int"))
    else:
        raise ValueError(f"no quality scale {scale!r}")
    return F.when(q < 0, F.raise_error(F.lit("quality below the scale"))).otherwise(q.cast("int"))


def integer_quality(number: Column, capped: bool = True) -> Column:
    """Phred quality of a number: 93 at most, or, as in four-line records, negative numbers are 0."""
    return F.least(number, F.lit(93)).cast("int") if capped else F.greatest(number, F.lit(0)).cast("int")


def quality_string(numbers: Column) -> Column:
    """Array of Phred numbers -> phred33 string."""
    return F.array_join(F.transform(numbers, lambda q: F.chr(F.least(F.greatest(q, F.lit(0)), F.lit(93)) + 33)), "")


def mismatch_penalty(quality: Column, s: Scoring = Scoring()) -> Column:
    """Between the least and the largest penalty, by quality up to 40; cut, not rounded."""
    if s.ignore_quals:
        return F.lit(s.mismatch_max)
    part = F.least(quality, F.lit(40)) / F.lit(40.0) * F.lit(float(s.mismatch_max - s.mismatch_min))
    return (F.lit(s.mismatch_min) + part.cast("int")).cast("int")


def base_score(read: Column, ref: Column, quality: Column, s: Scoring = Scoring()) -> Column:
    """Score of one pair of letters: an N on either side costs the N penalty."""
    known = F.instr(F.lit("ACGT"), F.upper(read)) * F.instr(F.lit("ACGT"), F.upper(ref)) > 0
    return F.when(~known, F.lit(-s.n_penalty)).when(F.upper(read) == F.upper(ref), F.lit(s.match)).otherwise(-mismatch_penalty(quality, s)).cast("int")


def ungapped_score(read: Column, ref: Column, s: Scoring = Scoring()) -> Column:
    """Score of two base strings of one length on one diagonal, all bases of the best quality."""
    worst, n = s.mismatch_max, s.n_penalty
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    cost = F.zip_with(letters(read), letters(ref), lambda a, b: F.when(~a.isin(*"ACGT") | ~b.isin(*"ACGT"), -n).when(a == b, s.match).otherwise(-worst))
    return F.aggregate(cost, F.lit(0).cast("long"), lambda acc, x: acc + x)


def clip_penalty(quality_char: Column, s: Scoring = Scoring()) -> Column:
    """Of one clipped base, by its phred33 character."""
    q = F.greatest(F.ascii(quality_char) - 33, F.lit(0))
    part = F.least(q, F.lit(40)) / F.lit(40.0) * F.lit(float(s.clip_max - s.clip_min))
    return (F.lit(s.clip_min) + part.cast("int")).cast("int")


def gap_penalty(length: Column, read_gap: bool = True, s: Scoring = Scoring()) -> Column:
    """Of a gap of so many bases; the first costs opening and one extension."""
    opening, extend = (s.read_gap_open, s.read_gap_extend) if read_gap else (s.ref_gap_open, s.ref_gap_extend)
    return F.when(length > 0, F.lit(opening) + length * F.lit(extend)).otherwise(0).cast("int")


def max_gaps(min_score: Column, length: Column, read_gap: bool = True, s: Scoring = Scoring()) -> Column:
    """How many bases of gap leave a perfect read at min_score or above."""
    opening, extend = (s.read_gap_open, s.read_gap_extend) if read_gap else (s.ref_gap_open, s.ref_gap_extend)
    lost = 0 if read_gap else s.match
    room = length * F.lit(s.match) - min_score
    return F.when(room >= opening + extend + lost, F.floor((room - F.lit(opening)) / F.lit(float(extend + lost)))).otherwise(0).cast("int")


def canonical_splice_penalty(intron: Column, anchor: Column, probability: Column, s: Scoring = Scoring()) -> Column:
    """Never negative; a short anchor with an unlikely site is ruled out."""
    cost = F.greatest(s.canonical_intron.column(intron).cast("int"), F.lit(0)) + s.canonical
    return F.when((anchor < s.min_anchor) & (probability < 0.1), F.lit(2147483647)).otherwise(cost).cast("int")


def noncanonical_splice_penalty(intron: Column, anchor: Column, s: Scoring = Scoring()) -> Column:
    cost = F.greatest(s.noncanonical_intron.column(intron).cast("int"), F.lit(0)) + s.noncanonical
    return F.when(anchor < s.min_anchor_noncanonical, F.lit(2147483647)).otherwise(cost).cast("int")


def _power(shift: Column) -> Column:
    """2**shift for 0 to 30."""
    return F.element_at(F.array(*(F.lit(1 << k) for k in range(31))), shift + 1)


def max_intron(anchor: Column, min_anchor: int = 7) -> Column:
    """Longest intron that a canonical site may have next to an anchor of so many bases."""
    shift = F.least(F.greatest(F.greatest(anchor, F.lit(2)) * 2 - 4, F.lit(13)), F.lit(30))
    return F.when(anchor >= min_anchor, _power(shift)).otherwise(0).cast("int")


def max_intron_noncanonical(anchor: Column, min_anchor: int = 14) -> Column:
    shift = F.least(F.greatest(anchor, F.lit(5)) * 2 - 10, F.lit(30))
    return F.when(anchor >= min_anchor, _power(shift)).otherwise(0).cast("int")


def required_probability(intron: Column) -> Column:
    """Least probability of a canonical site, by the length of its intron (fixed values)."""
    steps = ((1 << 16, 0.99), (1 << 15, 0.97), (1 << 14, 0.94), (1 << 13, 0.91), (1 << 12, 0.88))
    out = F.lit(0.8)
    for least, p in reversed(steps):
        out = F.when(intron >= least, F.lit(p)).otherwise(out)
    return out


#: Fixed values of the splice-site model: shares of A, C, G, T at each place of a donor (3 bases of the exon, 6 of the intron) and of an acceptor (14 of the intron, 1 of the exon), and in the genome.
DONOR = (
    (0.340, 0.604, 0.092, 0.001, 0.001, 0.526, 0.713, 0.071, 0.160),
    (0.363, 0.129, 0.033, 0.001, 0.001, 0.028, 0.076, 0.055, 0.165),
    (0.183, 0.125, 0.803, 1.000, 0.001, 0.419, 0.118, 0.814, 0.209),
    (0.114, 0.142, 0.073, 0.001, 1.000, 0.025, 0.093, 0.059, 0.462),
)
ACCEPTOR = (
    (0.090, 0.084, 0.075, 0.068, 0.076, 0.080, 0.097, 0.092, 0.076, 0.078, 0.237, 0.042, 1.000, 0.001, 0.239),
    (0.310, 0.310, 0.307, 0.293, 0.326, 0.330, 0.373, 0.385, 0.410, 0.352, 0.309, 0.708, 0.001, 0.001, 0.138),
    (0.125, 0.115, 0.106, 0.104, 0.110, 0.113, 0.113, 0.085, 0.066, 0.064, 0.212, 0.003, 0.001, 1.000, 0.520),
    (0.463, 0.440, 0.470, 0.494, 0.471, 0.463, 0.408, 0.429, 0.445, 0.504, 0.240, 0.246, 0.001, 0.001, 0.104),
)
GENOME = (0.27, 0.23, 0.23, 0.27)


def _ratio(window: Column, shares: tuple, background: tuple) -> Column:
    """Product over the places of a base's share to its share in the background; null where a letter is unknown."""
    ratio = F.lit(1.0)
    for k in range(len(shares[0])):
        at = F.nullif(F.instr(F.lit("ACGT"), F.substring(window, k + 1, 1)), F.lit(0))
        ratio = ratio * F.element_at(F.array(*(F.lit(row[k] / b) for row, b in zip(shares, background, strict=True))), at)
    return ratio


def site_probability(donor: Column, acceptor: Column, donor_shares: tuple = DONOR, acceptor_shares: tuple = ACCEPTOR, background: tuple = GENOME) -> Column:
    """Probability, r / (1 + r) for the likelihood ratio r, that the bases around both ends of an intron are those of a splice site; null where a base is unknown."""
    long = lambda c, shares: F.length(c) == len(shares[0])
    r = _ratio(donor, donor_shares, background) * _ratio(acceptor, acceptor_shares, background)
    return F.when(long(donor, donor_shares) & long(acceptor, acceptor_shares), r / (r + F.lit(1.0)))


def composite_score(score: Column, repeat: Column, transcript: Column, splice: Column, trimmed: Column) -> Column:
    """One number that ranks alignments: score, then repeat, known transcript (0 to 2), cheap junctions, little trimming."""
    low = F.shiftleft(repeat.cast("long"), 28) + F.shiftleft(transcript.cast("long"), 24) + F.shiftleft((F.lit(255) - F.least((splice / 100).cast("int"), F.lit(255))).cast("long"), 16)
    return score.cast("long") * F.lit(1 << 32) + low + (F.lit(65535) - F.least(trimmed, F.lit(65535))).cast("long")
