"""Ranking, redundancy, top-k, categories and mapping quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_alignments(alns: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each place, strand and edit list of a read."""
    return alns.dropDuplicates([*keys, "chrom_id", "pos", "fw", "cigar", "md"])


def needed_introns(alns: DataFrame, keys: list[str], introns: Column) -> DataFrame:
    """Without alignments that another one of the read, with the same start or the same end and fewer introns, equals or betters."""
    out = alns.withColumn("_introns", introns)
    for edge in ("pos", "end"):
        fewer = Window.partitionBy(*keys, "chrom_id", "fw", edge).orderBy("_introns").rangeBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"_by_{edge}", F.max("score").over(fewer))
    better = F.greatest("_by_pos", "_by_end")
    return out.where(better.isNull() | (better < F.col("score"))).drop("_introns", "_by_pos", "_by_end")


def distinct_cells(alns: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Drops an alignment (blocks: array of (read_off, ref_off, len)) that shares a (read, reference) cell with a better one of its read.

    Two blocks share a cell if they lie on one diagonal and overlap; so cells are never listed.
    """
    named = alns.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    block = named.select(*keys, "_n", "chrom_id", "fw", F.explode("blocks").alias("b")).select(*keys, "_n", "chrom_id", "fw", (F.col("b.ref_off") - F.col("b.read_off")).alias("diagonal"), F.col("b.read_off").alias("from"), (F.col("b.read_off") + F.col("b.len")).alias("to"))
    w = Window.partitionBy(*keys, "chrom_id", "fw", "diagonal").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    better = block.withColumn("_before", F.collect_list(F.struct("from", "to")).over(w))
    lost = better.where(F.exists("_before", lambda x: (x["from"] < F.col("to")) & (F.col("from") < x["to"]))).select(*keys, "_n").distinct()
    return named.join(lost, [*keys, "_n"], "left_anti").drop("_n")


def top_k(alns: DataFrame, keys: list[str], k: int, score: str = "score", tie: str = "tie", secondary: bool = False, exempt: Column | None = None) -> DataFrame:
    """The k best rows of each read with their rank; without secondary, only those that tie with the best. exempt rows are not cut."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    ranked = alns.withColumn("rank", F.row_number().over(w)).withColumn("_best", F.max(score).over(Window.partitionBy(*keys)))
    kept = F.col("rank") <= k
    if exempt is not None:
        kept |= exempt
    if not secondary:
        kept &= F.col(score) == F.col("_best")
    return ranked.where(kept).drop("_best")


def random_k(alns: DataFrame, keys: list[str], k: int, seed: int = 0) -> DataFrame:
    """k rows of each read in the order of a hash, so that reruns agree."""
    h = F.xxhash64(F.lit(seed), *keys, *(F.col(c) for c in ("chrom_id", "pos")))
    return alns.withColumn("_h", h).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_n") <= k).drop("_h", "_n")


def best_and_second(alns: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(keys, best, second, n): the two best scores, ties included, and the number of alignments."""
    ranked = alns.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score))))
    at = lambda n: F.max(F.when(F.col("_n") == n, F.col(score)))
    return ranked.groupBy(*keys).agg(at(1).alias("best"), at(2).alias("second"), F.count("*").alias("n"))


def category(n_concordant: Column, n1: Column, n2: Column, discordant: bool = True, mixed: bool = True) -> Column:
    """concordant, discordant (none concordant, one alignment of each mate), unpaired, or none."""
    out = F.when(n_concordant > 0, "concordant")
    if discordant:
        out = out.when((n1 == 1) & (n2 == 1), "discordant")
    if mixed:
        out = out.when((n1 > 0) | (n2 > 0), "unpaired")
    return out.otherwise("none")


def discordant_pairs(mates: DataFrame) -> DataFrame:
    """(rdid, a, b): the single alignments of both mates of pairs in category discordant."""
    told = F.struct(*(c for c in mates.columns if c not in ("rdid", "category")))
    one = lambda m: F.first(F.when(F.col("mate") == m, told), ignorenulls=True)
    return mates.where("category = 'discordant'").groupBy("rdid").agg(one(1).alias("a"), one(2).alias("b"))


#: For a runner-up at a distance of at least this share of the range, the quality of a
#: perfect best alignment, then pairs (share by which the best lies over the least score, quality), then the rest.
SECOND = (
    (0.9, 39, (), 33),
    (0.8, 38, (), 27),
    (0.7, 37, (), 26),
    (0.6, 36, (), 22),
    (0.5, 35, ((0.84, 25), (0.68, 16)), 5),
    (0.4, 34, ((0.84, 21), (0.68, 14)), 4),
    (0.3, 32, ((0.88, 18), (0.67, 15)), 3),
    (0.2, 31, ((0.88, 17), (0.67, 11)), 0),
    (0.1, 30, ((0.88, 12), (0.67, 7)), 0),
)
SINGLE = ((0.8, 42), (0.7, 40), (0.6, 24), (0.5, 23), (0.4, 8), (0.3, 3))


def mapq(best: Column, second: Column, perfect: Column, least: Column, exhausted: Column | None = None) -> Column:
    """Mapping quality: 60 if the best score stands alone and the search was complete, else by the ladder of how good the best is and how far the runner-up."""
    over, span = (best - least).cast("double"), (perfect - least).cast("double")
    apart = F.abs(F.abs(best) - F.abs(second)).cast("double")
    step = lambda pairs, rest, value: reduce(lambda out, x: F.when(value >= span * x[0], x[1]).otherwise(out), reversed(pairs), F.lit(rest))
    ladder = F.when(apart > 0, F.when(over >= span * 0.67, 6).otherwise(2)).otherwise(F.when(over >= span * 0.67, 1).otherwise(0))
    for share, whole, pairs, rest in reversed(SECOND):
        ladder = F.when(apart >= span * share, F.when(over == span, whole).otherwise(step(pairs, rest, over))).otherwise(ladder)
    alone = second.isNull() | (second != best)
    complete = ~exhausted if exhausted is not None else F.lit(True)
    return F.when(best.isNull(), F.lit(None)).when(alone & complete, 60).when(second.isNull(), step(SINGLE, 0, over)).otherwise(ladder).cast("int")


#: Fixed values of the binned scheme: quality by tenth of the loss of the best score (rows of BINNED: by tenth of the distance to the runner-up).
BINNED_ALONE = (43, 42, 41, 36, 32, 27, 20, 11, 4, 1, 0)
BINNED_PERFECT = (2, 16, 23, 30, 31, 32, 34, 36, 38, 40, 42)
BINNED = (
    (2, 2, 2, 1, 1, 0, 0, 0, 0, 0, 0),
    (20, 14, 7, 3, 2, 1, 0, 0, 0, 0, 0),
    (20, 16, 10, 6, 3, 1, 0, 0, 0, 0, 0),
    (20, 17, 13, 9, 3, 1, 1, 0, 0, 0, 0),
    (21, 19, 15, 9, 5, 2, 2, 0, 0, 0, 0),
    (22, 21, 16, 11, 10, 5, 0, 0, 0, 0, 0),
    (23, 22, 19, 16, 11, 0, 0, 0, 0, 0, 0),
    (24, 25, 21, 30, 0, 0, 0, 0, 0, 0, 0),
    (30, 26, 29, 0, 0, 0, 0, 0, 0, 0, 0),
    (30, 27, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (30, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
)
BINNED_PAIR, BINNED_ALONE_PERFECT, BINNED_SINGLE = 44, 44, 255


def mapq_binned(best: Column, second: Column, perfect: Column, least: Column, paired: Column | None = None, exhausted: Column | None = None) -> Column:
    """Mapping quality by tenths of the score range: of the loss of the best score and of its distance to the runner-up. Pairs get one value; a read without a runner-up is judged by its loss where the search was exhausted, else it gets BINNED_SINGLE."""
    span = F.greatest((perfect - least).cast("double"), F.lit(1e-9))
    tenth = lambda x: F.least(F.greatest((x * (10.0 / span) + 0.5).cast("int"), F.lit(0)), F.lit(10))
    loss = perfect - best
    table = F.array(*(F.array(*map(F.lit, row)) for row in BINNED))
    told = F.element_at(F.element_at(table, tenth(best - second) + 1), tenth(loss) + 1)
    whole = F.element_at(F.array(*map(F.lit, BINNED_PERFECT)), tenth(loss) + 1)
    alone = F.when(loss == perfect, BINNED_ALONE_PERFECT).otherwise(F.element_at(F.array(*map(F.lit, BINNED_ALONE)), tenth(loss) + 1))
    single = F.when(exhausted, alone).otherwise(BINNED_SINGLE) if exhausted is not None else F.lit(BINNED_SINGLE)
    out = F.when(best.isNull(), F.lit(None)).when(second.isNull(), single).when(loss == perfect, whole).otherwise(told)
    return (F.when(paired, BINNED_PAIR).otherwise(out) if paired is not None else out).cast("int")


def mapq_simple(second: Column) -> Column:
    """Earliest scheme: 255 without a runner-up, else 1 for ties and near ties."""
    return F.when(second.isNull(), 255).otherwise(1)


def seed_cap(seeds: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The most longest seeds of each read; ties by place."""
    w = Window.partitionBy(*keys).orderBy(F.desc("len"), "chrom_id", "pos", "fw")
    return seeds.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def repeat_choice(hits: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Repeat hits within budget of the best score; of each repeat, the best."""
    best = F.max("score").over(Window.partitionBy(*keys))
    near = hits.withColumn("_best", best).where(F.col("score") >= F.col("_best") - budget).drop("_best")
    w = Window.partitionBy(*keys, "rep_id").orderBy(F.desc("score"), "pos")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
