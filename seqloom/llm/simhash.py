"""SimHash fingerprints and Hamming search (operator 7), on DataFrame functions only.

A term is a word with the word before it (A-Z lower-cased); its weight is its length in characters,
30 at most, as longer terms are rarer. Each term's 64-bit hash votes, with its weight, for or against
every bit. Votes are counted two bits to a long (32-bit fields), so one pass of 32 sums serves all
64 bits inside generated code, and map-side aggregation leaves one row per text.

Search: fingerprints are cut into six blocks; two within radius 3 agree on at least three whole
blocks, so twenty tables, each keyed by three blocks (31 to 33 bits), hold every pair.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cuts_of, materialize, part_of

BITS, RADIUS, BLOCKS, MAX_WEIGHT = 64, 3, (11, 11, 11, 11, 10, 10), 30
_FIELDS = 0x0000000100000001
#: Rows of a bucket of the order by doc_id, about, where the session has fewer partitions.
ROWS_EACH = 20_000


def fingerprints(texts: DataFrame, keys: list[str], carried: list[str] | None = None) -> DataFrame:
    """keys, carried columns (any one value of each; numbers, so that the sums stay in a hash table) and fingerprint (long) for every combination of keys; texts has text too.

    Null, empty and blank texts get fingerprint 0; a bit whose votes are even is 0. Rows that agree on keys vote together.
    """
    carried = carried or []
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    words = texts.select(*keys, *carried, words.alias("_words"))
    pairs = F.expr(
        f"zip_with(_words, slice(concat(array(''), _words), 1, size(_words)), (w, before) -> struct(xxhash64(before, w) as h, least(length(w) + length(before), {MAX_WEIGHT}) as weight))"
    )
    terms = words.select(*keys, *carried, F.explode_outer(pairs).alias("_t")).select(*keys, *carried, F.col("_t.h").alias("_h"), F.col("_t.weight").cast("long").alias("_w"))
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(_FIELDS)) * F.col("_w")).alias(f"_v{k}") for k in range(32)]
    votes = terms.groupBy(*keys).agg(*(F.first(c).alias(c) for c in carried), F.sum("_w").alias("_all"), *sums)
    fields = [F.col(f"_v{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(32)] + [F.shiftrightunsigned(f"_v{k}", 32) for k in range(32)]
    bits = F.lit(0).cast("long")
    for k, v in enumerate(fields):
        bits = bits.bitwiseOR(F.when(v * 2 > F.col("_all"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, *carried, bits.alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def _tables(fps: DataFrame, column: str) -> DataFrame:
    """Twenty rows for each fingerprint: table and the bits of its three blocks, moved to the front."""
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    block = [F.shiftrightunsigned(column, starts[k]).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1)) for k in range(len(BLOCKS))]
    keys = [
        F.struct(F.lit(t).alias("t"), F.shiftleft(block[a], BLOCKS[b] + BLOCKS[c]).bitwiseOR(F.shiftleft(block[b], BLOCKS[c])).bitwiseOR(block[c]).alias("blocks"))
        for t, (a, b, c) in enumerate(combinations(range(len(BLOCKS)), 3))
    ]
    return fps.select(column, F.explode(F.array(*keys)).alias("_k")).select(column, F.col("_k.t").alias("_t"), F.col("_k.blocks").alias("_blocks"))


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, found, distance): every fingerprint of fps (fingerprint) within radius of one of queries (fingerprint).

    Both sides are made distinct first, so copies cost one row. radius is at most 3. A pair that
    agrees on several tables is given by the first of them only, without a distinct over the pairs.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be from 0 to {RADIUS}")
    left = _tables(queries.select(F.col("fingerprint").alias("query")).where("query is not null").distinct(), "query")
    right = _tables(fps.select(F.col("fingerprint").alias("found")).where("found is not null").distinct(), "found")
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    x = F.col("query").bitwiseXOR(F.col("found"))
    same = [x.bitwiseAND(F.lit(m - (1 << 64) if (m := ((1 << BLOCKS[k]) - 1) << starts[k]) >= 1 << 63 else m)) == 0 for k in range(len(BLOCKS))]
    first = F.coalesce(*(F.when(same[a] & same[b] & same[c], F.lit(t)) for t, (a, b, c) in enumerate(combinations(range(len(BLOCKS)), 3))))
    d = distance(F.col("query"), F.col("found"))
    left, right = left.withColumnsRenamed({"_t": "_t1", "_blocks": "_b1"}), right.withColumnsRenamed({"_t": "_t2", "_blocks": "_b2"})
    # each side has twenty times the rows that it is estimated by: never broadcast
    near = left.hint("shuffle_merge").join(right, (F.col("_t1") == F.col("_t2")) & (F.col("_b1") == F.col("_b2")) & (d <= radius) & (F.col("_t1") == first))
    return near.select("query", "found", d.alias("distance"))


def near_classes(queries: DataFrame, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """What lies within radius of each fingerprint of queries (doc_id, fingerprint) among docs (doc_id, fingerprint; queries are some of them).

    query, first_id (the smallest doc_id of queries that has it), n_near (other fingerprints),
    n_near_docs (documents, the copies of the query too, less the query itself) and near_classes:
    (distance, doc_id, n_docs) of each other fingerprint, doc_id being the smallest that has it.
    The search runs over distinct fingerprints, so copies cost nothing and are still counted.
    """
    classes = docs.groupBy("fingerprint").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first"))
    asked = queries.groupBy(F.col("fingerprint").alias("query")).agg(F.min("doc_id").alias("first_id"))
    found = within_radius(queries, docs, radius).join(classes, F.col("found") == F.col("fingerprint"))
    other = F.when(F.col("found") != F.col("query"), F.struct("distance", F.col("_first").alias("doc_id"), F.col("_n").alias("n_docs")))
    near = found.groupBy("query").agg((F.count("*") - 1).alias("n_near"), (F.sum("_n") - 1).alias("n_near_docs"), F.array_sort(F.collect_list(other)).alias("near_classes"))
    return near.join(asked, "query")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with place, next_place and next_text: a number of each row, and of the next row by descending doc_id, of the first after the last.

    Rows that share a doc_id follow by their text, rows without one come last. Rows are cut into
    buckets of about ROWS_EACH by quantiles of doc_id, so no task sorts them all; the first row of
    each bucket is also sent to the end of the bucket before it.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cuts_of(docs, "doc_id", max(4 * parts, math.ceil(docs.count() / ROWS_EACH)))
    # descending: the bucket of the largest doc_ids is the first, that of rows without one the last
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - part_of(F.col("doc_id"), cuts))
    rows = docs.withColumn("_bucket", bucket)
    order = F.struct(F.bitwise_not("doc_id"), F.col("text"))
    # one row for each bucket: its first text
    firsts = rows.groupBy("_bucket").agg(F.min_by(F.struct("doc_id", "text"), order).alias("_f"))
    before = F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.max("_bucket").over(Window.partitionBy()))
    sent = firsts.select(before.alias("_bucket"), F.col("_f.doc_id").alias("doc_id"), F.col("_f.text").alias("text"), F.lit(True).alias("_ghost"), _place(F.col("_bucket"), F.lit(1)).alias("_at"))
    every = rows.select("_bucket", "doc_id", "text", F.lit(False).alias("_ghost"), F.lit(None).cast("long").alias("_at")).unionByName(sent)
    w = Window.partitionBy("_bucket").orderBy("_ghost", F.desc_nulls_last("doc_id"), "text")
    numbered = every.withColumn("place", F.coalesce("_at", _place(F.col("_bucket"), F.row_number().over(w))))
    ahead = numbered.withColumn("next_place", F.lead("place").over(w)).withColumn("next_text", F.lead("text").over(w))
    return ahead.where("not _ghost").select("place", "doc_id", "text", "next_place", "next_text")


def _place(bucket: Column, row: Column) -> Column:
    return F.shiftleft(bucket.cast("long"), 40).bitwiseOR(row.cast("long"))


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 3) code points replaced by the first as many (or all) of other."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text and of its edited text, and what lies near it; one row for each row of docs.

    docs: doc_id, text (other columns are not read). A null text counts as empty. Rows that share a
    doc_id, repeated rows too, each have a place in the order, by their text; rows without a doc_id
    come after all others. A single document is its own next one.
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited,
    near_next (1 - distance / 64), and for doc_ids divisible by 20, else null: n_near, how many other
    fingerprints lie within RADIUS bits; n_near_docs, how many other documents have one of these or
    the same; near_classes, the links of near_classes(), given once for each fingerprint, at the
    smallest of these doc_ids that has it. The documents of a class are those that share the
    fingerprint of its doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = with_next(docs)
    own, other = F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), edited(F.col("text"), F.col("next_text")).alias("text"))
    kinds = placed.select("place", "doc_id", "next_place", F.explode(F.array(own, other)).alias("t")).select("place", "doc_id", "next_place", "t.kind", "t.text")
    digest = F.when(F.col("kind") == 1, F.sha2(F.encode("text", "UTF-8"), 256))
    parts = [F.conv(F.substring("digest", 16 * k + 1, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    kinds = kinds.withColumn("n_chars", F.length("text").cast("long")).withColumn("digest", digest).select("place", "kind", "doc_id", "next_place", "n_chars", "text", *parts)
    found = materialize(fingerprints(kinds, ["place", "kind"], ["doc_id", "next_place", "n_chars", "sha0", "sha1", "sha2", "sha3"]), "fingerprints")
    own = found.where("kind = 0").select("place", "doc_id", "next_place", "n_chars", "fingerprint")
    other = found.where("kind = 1").select("place", F.concat(*(hex16(F.col(f"sha{k}")) for k in range(4))).alias("edited_sha256"), F.col("fingerprint").alias("edited_fingerprint"))
    following = own.select(F.col("place").alias("next_place"), F.col("fingerprint").alias("next_fingerprint"))
    asked = own.where("doc_id % 20 = 0").select("place", "doc_id", "fingerprint")
    # lists of links may be large: never broadcast
    named = asked.select(F.struct("doc_id", "place").alias("doc_id"), "fingerprint")  # repeated rows have one doc_id
    near = asked.join(near_classes(named, own).hint("shuffle_merge"), F.col("fingerprint") == F.col("query"))
    near = near.select("place", "n_near", "n_near_docs", F.when(F.struct("doc_id", "place") == F.col("first_id"), F.col("near_classes")).alias("near_classes"))
    rows = own.join(other, "place").join(near, "place", "left").join(following, "next_place")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex16(F.col("fingerprint")).alias("fingerprint"),
        hex16(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "n_near",
        "n_near_docs",
        "near_classes",
    )
