"""Merkle manifest of a dataset, built and checked by supersteps (operator 12).

Each document is a leaf: the digest of its fields. The leaves of one group (a language) are put in
order by a range sort, numbered from the totals of its partitions, and are the lowest nodes of a tree
in which every FAN consecutive nodes have a parent; the tops of all trees, in the order of their
groups, are the leaves of one more tree, whose top is the root.

Supersteps are RDD jobs, as in Pregel. Upward, every node sends its digest to its parent (a combiner
puts the messages of one partition together); a parent that has all its children hashes them and
is a node of the next superstep. Downward, every parent sends what lies beside and above it to its
children, at the last step to the leaves, which fold their digest of now with it and compare the
result with the root. A parent has FAN children at most, so no key is hot; the number of supersteps
is the logarithm of the largest group. What a superstep gives is written to the shared folder, so
lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes in a partition of a superstep, about, where the session has fewer partitions.
NODES_EACH = 1 << 17
_SIZE = 32  # bytes of a digest
_NODE = "tree long, place long, n long, digest binary"
_SENT = "tree long, place long, message binary"


def leaf_digest(fields: list[Column]) -> Column:
    """Digest (hex) of fields: each is ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def digest_of(digests: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds tree (a number of the group's own), place (0, 1, ... in order within the group) and n (rows of the group). No null in group.

    The range sort gives partitions in order; a row for each group and partition tells what lies before.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // NODES_EACH))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    # in a partition the numbers ascend with the order; its own number is in the high bits
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33).alias("part")
    runs = dealt.groupBy(group, part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    every = Window.partitionBy(group)
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(every).alias("n"), F.min("first").over(every).alias("tree"))
    placed = dealt.withColumn("part", part).join(runs, [group, "part"])
    return placed.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _partition(key: tuple[int, int]) -> int:
    return (key[0] * 0x9E3779B1 + key[1] * 0x85EBCA6B >> 7) & 0x7FFFFFFF


def _partitions(nodes: DataFrame, count: int) -> int:
    return max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // NODES_EACH))


def _up(nodes: DataFrame, count: int) -> DataFrame:
    """The parents of nodes (those of trees with more than one node on this level)."""

    def message(node: Row) -> tuple:
        return (node.tree, node.place // FAN), [(node.place % FAN, bytes(node.digest), node.n)]

    def complete(box: tuple) -> tuple:
        (tree, place), got = box
        n = got[0][2]
        if sorted(x[0] for x in got) != list(range(min(FAN, n - place * FAN))):
            raise ValueError(f"node {place} of tree {tree} has not got every child once")
        return tree, place, -(-n // FAN), digest_of([x[1] for x in sorted(got)])

    parents = nodes.rdd.map(message).reduceByKey(lambda x, y: x + y, _partitions(nodes, count), _partition).map(complete)
    return nodes.sparkSession.createDataFrame(parents, _NODE, verifySchema=False)


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of every level (tree, place, n: nodes of the tree on this level, digest); leaves are the first. The top of a tree is the node with n = 1."""
    levels = [leaves]
    while count := levels[-1].where("n > 1").count():
        levels.append(materialize(_up(levels[-1].where("n > 1").select("tree", "place", "n", "digest"), count), "nodes"))
    return levels


def _beside(children: RDD, told: RDD, partitions: int) -> RDD:
    """(place in the run, child, message of its parent with what lies beside the child put before) of children ((tree, parent), (slot, digest, child)) and told ((tree, parent), message)."""

    def send(box: tuple):
        _, (got, messages) = box
        got, (message,) = sorted(got, key=lambda x: x[0]), messages
        head, rest = message[: 2 * _SIZE], message[2 * _SIZE :]
        for slot, _, child in got:
            beside = b"".join(d for s, d, _ in got if s != slot)
            yield child, head + bytes((slot, len(got) - 1)) + beside + rest

    return children.cogroup(told, partitions).flatMap(send)


def descend(levels: list[DataFrame], told: DataFrame) -> RDD:
    """(row of the first level, message) for every row of it. told: (tree, message) for the top of each tree.

    A message: what the top was told first (two digests), then for each level the node's slot, the number of the others in its run, and their digests.
    """
    spark = told.sparkSession
    tops = [level.where("n = 1").join(told, "tree") for level in levels]
    sent = None
    for level, top in zip(levels[:0:-1], tops[:0:-1], strict=True):
        here = top.select("tree", "place", "message")
        if sent is not None:
            count = level.count()
            children = level.where("n > 1").rdd.map(lambda x: ((x.tree, x.place // FAN), (x.place % FAN, bytes(x.digest), (x.tree, x.place))))
            below = _beside(children, sent.rdd.map(lambda x: ((x.tree, x.place), bytes(x.message))), _partitions(level, count))
            here = here.unionAll(spark.createDataFrame(below.map(lambda x: (*x[0], x[1])), _SENT, verifySchema=False))
        sent = materialize(here, "messages")
    alone = tops[0].rdd.map(lambda x: (x, bytes(x.message)))
    if sent is None:
        return alone
    children = levels[0].where("n > 1").rdd.map(lambda x: ((x.tree, x.place // FAN), (x.place % FAN, bytes(x.digest), x)))
    return alone.union(_beside(children, sent.rdd.map(lambda x: ((x.tree, x.place), bytes(x.message))), _partitions(levels[0], levels[0].count())))


def path_of(message: bytes) -> list[tuple[int, list[bytes]]]:
    """(slot, digests of the run's others) of each level, from the leaf upward."""
    out, at = [], 2 * _SIZE
    while at < len(message):
        slot, n = message[at], message[at + 1]
        at += 2
        out.append((slot, [message[k : k + _SIZE] for k in range(at, at + n * _SIZE, _SIZE)]))
        at += n * _SIZE
    return out


def fold(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf's digest and its path give."""
    for slot, others in path:
        leaf = digest_of([*others[:slot], leaf, *others[slot:]])
    return leaf


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, group (null: before all others), leaf, found (digest with the tampering below, null where nothing is tampered with) for every row of docs.

    Tampering: the text's A-Z in lower case, where 3 divides the crc32 of the decimal doc_id.
    """
    fields = [F.col(c) for c in FIELDS]
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    changed = leaf_digest([*fields[:-1], ascii_lower(F.col("text").cast("string"))])
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("group"), F.unhex(leaf_digest(fields)).alias("digest"), F.when(hit, F.unhex(changed)).alias("found"))


def verify(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of leaves.

    leaves: doc_id, group (not null; the order of the trees), digest (binary: as it was when the
    manifest was made), found (digest as it is now; null: the same). Within a group leaves stand by
    doc_id, those without one first, rows of one doc_id by their digest; repeated rows are leaves
    each. folded_root is what found and the path give; proof_sha256 is the digest of the path's
    digests. An empty table has no rows. The levels below the root are written tables (climb).
    """
    spark = leaves.sparkSession
    rows = leaves.select("doc_id", "group", "digest", "found")
    rows = materialize(numbered(materialize(rows, "leaves"), "group", ["doc_id", "digest"]), "leaves")
    levels = climb(rows)
    tops = reduce(DataFrame.unionAll, [x.where("n = 1").select("tree", "digest") for x in levels])
    groups = rows.where("place = 0").select("group", F.col("tree").alias("of"))
    heads = groups.join(tops, groups["of"] == tops["tree"]).select("group", "of", "digest", F.lit("").alias("all"))
    above = climb(materialize(numbered(materialize(heads, "heads"), "all", ["group"]), "heads"))
    empty = spark.createDataFrame([], "tree long, message binary")
    root = reduce(DataFrame.unionAll, [x.where("n = 1").select("tree", F.concat("digest", "digest").alias("message")) for x in above], empty)
    # the first of the two digests becomes the tree's own top
    told = descend(above, root).map(lambda x: (x[0].of, bytes(x[0].digest) + x[1][_SIZE:]))
    told = materialize(spark.createDataFrame(told, "tree long, message binary", verifySchema=False), "told")

    def result(box: tuple[Row, bytes]) -> tuple:
        leaf, message = box
        path, root = path_of(message), message[_SIZE : 2 * _SIZE]
        folded = fold(bytes(leaf.digest if leaf.found is None else leaf.found), path)
        proof = digest_of([d for _, others in path for d in others])
        return leaf.doc_id, leaf.digest.hex(), message[:_SIZE].hex(), root.hex(), proof.hex(), folded.hex(), folded == root

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return spark.createDataFrame(descend(levels, told).map(result), schema, verifySchema=False)
