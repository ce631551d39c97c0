"""Mixing sources to target weights by weighted fair queueing (operator 8).

Every document is offered once for each epoch its source may need. Within a source, documents stand
in a shuffled order (by a hash of doc_id), epoch after epoch; an offer's virtual finish time is the
source's words up to and with it, divided by the source's target; half of the document's own words
are taken off, so that the cut rounds each source to the nearest document. Offers of all sources are
sorted by that time, and the stream is cut where the total budget is used up; then every source has
come near its target. Running sums are taken over buckets of the order, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, materialize, prefix_sums, row_hash, spare

WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
_BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, place (0, 1, ...) and target from sizes (source, size): one row for each source, null last.

    Shares of the sum of all sizes go by weight; a target stops at max_epochs times its source's
    size and the excess is reshared by weight until none is above. Sources are ordered by size over
    weight: those that stop are a prefix of that order, so one pass of running sums settles all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row for each source
    place = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))) - 1).alias("place")
    ranked = per.select("source", "source_size", place)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weighed = (
        weighed.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("stops", F.col("fill") < F.col("level"))
    )
    # level at the first source that does not stop holds for all that follow
    level = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return weighed.withColumn("level", level).select("source", "source_size", "place", F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def mix_epochs(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs and same (a hash of all columns of the row) for every row of docs (doc_id, text, source).

    size is the text's number of words (null: 0); taken = epochs * size, epochs at most max_epochs.
    Null sources form one source. Rows without words are taken with 0 words (epochs 0). Repeated rows and null doc_ids are offered
    each on their own. The same rows give the same mix.
    """
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        row_hash(docs).alias("same"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    slim = materialize(slim, "sizes")
    targets = materialize(source_targets(slim, weights, max_epochs), "targets")
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    order = F.conv(F.substring(F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), 1, 8), 16, 10).cast("long")
    known = slim.join(targets, slim["source"].eqNullSafe(targets["source"])).select("row", "same", "doc_id", "size", "source_size", "place", "target", order.alias("_order"))
    known = known.withColumn("_bucket", F.shiftright("_order", 20).cast("int"))
    summed = prefix_sums(known, ["place"], "_bucket", ["_order", "doc_id", "row"], "size", "_upto")

    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    finish = (F.col("_epoch") * F.col("source_size") + F.col("_upto") - F.col("size") / 2) / F.col("target")
    offers = summed.where("size > 0").select("row", "doc_id", "size", "source_size", "target", "place", "_upto", F.explode(epochs).alias("_epoch")).withColumn("_finish", finish)
    # up to the cut virtual time runs evenly with the words taken, so equal steps of it are equal buckets; beyond it, equal ratios
    late = F.lit(_BUCKETS) + F.log2(F.greatest("_finish", F.lit(1.0))) * F.lit(_BUCKETS / 4)
    step = F.when(F.col("_finish") < 1, F.greatest("_finish", F.lit(0.0)) * F.lit(_BUCKETS)).otherwise(late)
    offers = materialize(offers.select("row", "doc_id", "size", "place", "_epoch", "_finish", F.floor(step).cast("int").alias("_bucket")), "offers")
    queue = prefix_sums(offers, [], "_bucket", ["_finish", "place", "_epoch", "doc_id", "row"], "size", "_total").where(F.col("_total") - F.col("size") / 2 <= budget)
    taken = queue.groupBy("row").agg(F.count("*").alias("epochs"))
    rows = summed.join(taken, "row", "left").withColumn("epochs", F.coalesce("epochs", F.lit(0)).cast("int"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"), "epochs", "same")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (a row without words never). Columns of any name and type come through as they are."""
    own = spare(docs)
    same, epochs = f"{own}same", f"{own}epochs"
    told = mix_epochs(docs, weights, max_epochs).where("epochs > 0").groupBy(F.col("same").alias(same)).agg(F.sum("epochs").alias(epochs))
    # rows that agree in all columns are one row that is taken as often as all of them
    rows = docs.withColumn(f"{own}hash", row_hash(docs)).dropDuplicates([f"{own}hash"])
    taken = rows.join(told, F.col(f"{own}hash") == F.col(same)).withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(epochs))))
    return taken.select(*map(column, docs.columns))
