"""Options of a run, and functions of the read length."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LengthFunction:
    """max(low, min(high, constant + slope * g(x))), g: C constant, L identity, S root, G natural logarithm. Results are cut, not rounded."""

    kind: str = "C"
    constant: float = 0.0
    slope: float = 0.0
    low: float = -math.inf
    high: float = math.inf

    @classmethod
    def parse(cls, text: str, low: float = -math.inf, high: float = math.inf) -> LengthFunction:
        """From ``C,5`` or ``L,0,-0.2``; a third number is the lower bound, a fourth the upper bound."""
        kind, *numbers = (x.strip() for x in text.split(","))
        if kind not in ("C", "L", "S", "G") or not numbers or len(numbers) > 4 or (kind != "C" and len(numbers) < 2):
            raise ValueError(f"not a function of the length: {text!r}")
        values = [float(x) for x in numbers]
        if kind == "C":
            return cls("C", values[0], 0.0, low, high)
        return cls(kind, *values[:2], *(values[2:] or [low]), *([] if len(values) > 3 else [high]))

    def value(self, x: float) -> float:
        g = {"C": 0.0, "L": x, "S": math.sqrt(max(x, 0)), "G": math.log(x) if x > 0 else -math.inf}[self.kind]
        return max(self.low, min(self.high, self.constant + (self.slope * g if self.slope else 0.0)))

    def column(self, x: Column) -> Column:
        d = x.cast("double")
        g = {"C": F.lit(0.0), "L": d, "S": F.sqrt(d), "G": F.ln(d)}[self.kind]
        out = F.lit(float(self.constant)) + F.lit(float(self.slope)) * g
        if self.high < math.inf:
            out = F.least(out, F.lit(float(self.high)))
        return F.greatest(out, F.lit(float(self.low))) if self.low > -math.inf else out

    def whole(self, x: Column) -> Column:
        return self.column(x).cast("long")


@dataclass(frozen=True)
class Scoring:
    """Fixed default values of the score scheme."""

    match: int = 0
    mismatch_max: int = 6
    mismatch_min: int = 2
    clip_max: int = 2
    clip_min: int = 1
    n_penalty: int = 1
    read_gap_open: int = 5
    read_gap_extend: int = 3
    ref_gap_open: int = 5
    ref_gap_extend: int = 3
    canonical: int = 0
    noncanonical: int = 12
    conflicting: int = 1_000_000
    ignore_quals: bool = False
    min_score: LengthFunction = field(default_factory=lambda: LengthFunction("L", 0.0, -0.2))
    n_ceiling: LengthFunction = field(default_factory=lambda: LengthFunction("L", 0.0, 0.15))
    canonical_intron: LengthFunction = field(default_factory=lambda: LengthFunction("G", -8.0, 1.0))
    noncanonical_intron: LengthFunction = field(default_factory=lambda: LengthFunction("G", -8.0, 1.0))
    min_anchor: int = 7
    min_anchor_noncanonical: int = 14
    min_intron: int = 20
    max_intron: int = 500_000


@dataclass(frozen=True)
class Options:
    """Options of an alignment run; dead options of the command line are not kept."""

    scoring: Scoring = field(default_factory=Scoring)
    skip: int = 0
    upto: int | None = None
    sample: float = 1.0
    seed: int = 0
    trim5: int = 0
    trim3: int = 0
    quals: str = "phred33"
    qc_filter: bool = False
    khits: int = 5
    max_seeds: int | None = None
    #: Seeds with more places than this are looked up by distinct repeated pieces, so that a common one does not give each read so many candidates.
    max_hits: int | None = 10_000
    kmer: int = 22
    #: Bases of the k-mers by which lost mates are searched near their anchored mates; none: they are not.
    rescue_kmer: int | None = None
    #: Bases of the k-mers by which the unexplained ends of any read are searched in the tiles beside its partial hits; none: they are not.
    end_kmer: int | None = None
    #: Ends may be clipped at the scoring's clip penalty; local: any part of a read may align, matches count two each, least score 20 + 8 ln(length).
    soft_clip: bool = False
    local: bool = False
    tile: int = 57344
    tile_overlap: int = 1024
    nofw: bool = False
    norc: bool = False
    policy: str = "fr"
    min_fragment: int = 0
    max_fragment: int = 1000
    dovetail: bool = False
    contain: bool = True
    overlap: bool = True
    mixed: bool = True
    discordant: bool = True
    spliced: bool = True
    secondary: bool = False
    no_unal: bool = False
    reorder: bool = False
    rna_strandness: str = ""
    transcriptome_only: bool = False
    max_alternatives: int = 16
    repeat: bool = True
    mapq: int = 2
    remove_chrname: bool = False
    add_chrname: bool = False
    rg_id: str = ""
    rg: tuple[str, ...] = ()
    no_hd: bool = False
    no_sq: bool = False

    @property
    def least_score(self) -> LengthFunction:
        return LengthFunction("G", 20.0, 8.0) if self.local else self.scoring.min_score

    @property
    def seeds(self) -> int:
        return self.max_seeds if self.max_seeds is not None else max(5, 2 * self.khits)

    def preset(self, name: str) -> Options:
        """fast, sensitive or very-sensitive."""
        if name in ("very-fast", "fast"):
            return replace(self, repeat=False)
        if name not in ("sensitive", "very-sensitive"):
            raise ValueError(f"no preset {name!r}")
        k, slope = (10, -0.5) if name == "sensitive" else (30, -1.0)
        return replace(self, khits=max(self.khits, k), scoring=replace(self.scoring, min_score=LengthFunction("L", 0.0, slope)))


@dataclass(frozen=True)
class RepeatOptions:
    seed_length: int = 50
    seed_count: int = 5
    min_length: int = 100
    max_length: int = 65535
    count: int = 5
    max_edit: int = 10
    forward_only: bool = False
    cg_to_tg: bool = False
