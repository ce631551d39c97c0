"""Jaccard join of word n-gram sets by signature trees (operator 13).

The distinct sets of shingles are the points: texts with one set are folded to one row, named by a
hash of the set. A set of n shingles has a bitmap of 2 n to 4 n bits (a power of two), a small set of 8 n
to 16 n, one for each shingle's hash.

Two sets with 100 * intersection >= 80 * union share a shingle among the first n - ceil(0.8 n) + 1 of
each, whatever order all shingles stand in. So every such shingle is the root of a tree of the sets
that have it so far in front, and pairs are only looked for inside trees; shingles with the same sets
are one tree. The order is by hash, but shingles that very many sets have in front (COMMON_SETS, as
those of passages that many documents share) stand behind all others.

In a tree the sets of the largest component stand first, then the others by size; FAN neighbours
have a node above them with their OR-combined bitmap, size range and component, FAN nodes have one
above, and so on. A dual traversal starts with the top and itself and drops a pair of nodes if all their sets lie in one component, if
the sizes are too far apart, or if the most that two of their sets can share is too little:

    shared <= excess + bit_count(a & b)      excess: the most shingles of a set that fell on a used bit
    100 * shared >= 80 * (smallest a + smallest b - shared)

All of it bounds the true values, so no link is lost. What is left at the bottom is a candidate, and
both texts are fetched to confirm it on the full sets. First every set is compared with one set of its
largest tree, so that large groups of near copies mostly are one component before trees are walked; of
the others in such a family, those over a fifth of whose shingles no other of its sets has are left out.

A tree of any size is cut into branches of at most BRANCH sets by a range sort, each a task's bounded
piece; pairs of branches of one tree are dropped by the same rules before their sets meet, and a pair of
sets that several trees have leaves the first of them only, if that is one of the first few trees of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize, small
from .graph import connected_components
from .near_dup import MAX_BROADCAST_IDS, WordHashes, overlaps, own_shingles, shingle_set, words_of

THRESHOLD = 80
#: Sets of a tree that are sorted by size in one task.
MAX_SORTED = 4096
#: Sets below a node; sets in a branch; bits of a bitmap at most.
FAN, BRANCH, MAX_BITS = 4, 8192, 1 << 15
#: Sets up to this size have four times as many bits for each shingle: they cost little, and copies that just miss the threshold are told apart.
SMALL = 256
#: A tree of so many sets, at least half of which are one component, is a family: its sets are asked how many shingles are their own.
FAMILY = 256
#: A shingle that more sets have in front is common; how many of them (the most common ones) are moved back at most, as the list is broadcast (8 bytes each). Those that stay in front make large trees.
COMMON_SETS, MAX_COMMON = 100_000, 100_000
#: Of the trees of a set, in the order of their keys, how many (the first ones) tell in later trees that a pair was met before.
FIRST_TREES = 8
#: Rows in an Arrow batch of whole texts; pairs of nodes that are compared at a time.
BATCH_ROWS, PAIRS_AT_A_TIME = 500, 1 << 14


def front(n: int) -> int:
    """How many shingles of a set of n stand in front."""
    return n - (THRESHOLD * n + 99) // 100 + 1 if n else 0


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of a set, as 64-bit words: the hash's low bits, as many as the set's size asks for. Sizes that can be linked have widths that are equal or differ by a step of two."""
    bits, asked = 64, len(shingles) * (8 if len(shingles) <= SMALL else 2)
    while bits < min(asked, MAX_BITS):
        bits *= 2
    out = np.zeros(bits, bool)
    out[shingles & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of words) cut to a smaller power of two of words."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


def front_of(shingles: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """The shingles in front: by hash, and those in common (hashes, the rarest first) behind all others."""
    need = front(len(shingles))
    if common is None or not len(common):
        return shingles[:need]
    order = np.argsort(common)
    at = np.minimum(np.searchsorted(common[order], shingles), len(common) - 1)
    is_common = common[order][at] == shingles
    found = shingles[~is_common][:need]
    if len(found) < need:
        later = shingles[is_common][np.argsort(order[at[is_common]])]
        found = np.concatenate([found, later[: need - len(found)]])
    return found


_SIGNED = "doc_id long, t long, rep long, n_shingles long, bits binary, front array<long>"


def signed(docs: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """doc_id, t (hash of the text), rep (a 63-bit hash of the set, its name), n_shingles, bits and front for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, common = WordHashes(), shared.value
        for batch in batches:
            reps, sizes, bits, fronts = [], [], [], []
            for text in batch.column(2):
                found = shingle_set(words_of(text.as_py()), hashes)
                reps.append(xxhash.xxh64_intdigest(found.tobytes()) >> 1)
                sizes.append(len(found))
                bits.append(bitmap(found).tobytes())
                fronts.append(front_of(found, common).view(np.int64))
            ends = np.cumsum([0, *map(len, fronts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*fronts, np.empty(0, np.int64)])))
            columns = [batch.column(0), batch.column(1), pa.array(reps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "rep", "n_shingles", "bits", "front"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(run, _SIGNED)


class Nodes:
    """The levels of a tree over sets in order: words (bitmaps), least and most (sizes), excess, root (component, or none: several). The sets are the first level."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, roots: np.ndarray):
        excess = sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.levels = [(words, sizes, sizes, excess, roots)]
        while len(sizes) > 1:
            words, least, most, excess, roots = self.levels[-1]
            at = np.arange(0, len(words), FAN)
            low, high = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
            level = (np.bitwise_or.reduceat(words, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(excess, at), np.where(low == high, low, -1))
            self.levels.append(level)
            sizes = level[1]


def may_link(one: tuple, two: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a of level one, b of level two) may hold a link between components."""
    words_a, least_a, most_a, excess_a, root_a = one
    words_b, least_b, most_b, excess_b, root_b = two
    fits = ~((root_a[a] == root_b[b]) & (root_a[a] != -1))
    fits &= (100 * most_a[a] >= THRESHOLD * least_b[b]) & (100 * most_b[b] >= THRESHOLD * least_a[a])
    keep = np.flatnonzero(fits)
    a, b = a[keep], b[keep]
    bits = np.bitwise_count(words_a[a] & words_b[b]).sum(axis=1, dtype=np.int64)
    shared = np.minimum(np.minimum(excess_a[a], excess_b[b]) + bits, np.minimum(most_a[a], most_b[b]))
    fits[keep] = 100 * shared >= THRESHOLD * (least_a[a] + least_b[b] - shared)
    return fits


def traverse(one: Nodes, two: Nodes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (of one, of two) that may be links; of one and the same tree each pair once. Depth first, PAIRS_AT_A_TIME pairs of nodes at a time."""
    top_one, top_two = len(one.levels) - 1, len(two.levels) - 1
    same = one is two
    stack = [(top_one, top_two, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, a, b = stack.pop()
        if len(a) > PAIRS_AT_A_TIME:
            stack.append((i, j, a[PAIRS_AT_A_TIME:], b[PAIRS_AT_A_TIME:]))
            a, b = a[:PAIRS_AT_A_TIME], b[:PAIRS_AT_A_TIME]
        keep = may_link(one.levels[i], two.levels[j], a, b)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if i == 0 and j == 0:
            yield a, b
            continue
        # the higher node opens; of one level both do
        if i >= j:
            a, b, i = *_opened(a, b, len(one.levels[i - 1][1])), i - 1
            if same or i < j:
                b, a = _opened(b, a, len(two.levels[j - 1][1]))
                j -= 1
        else:
            b, a = _opened(b, a, len(two.levels[j - 1][1]))
            j -= 1
        if same:
            keep = a <= b if i else a < b
            a, b = a[keep], b[keep]
        stack.append((i, j, a, b))


def _opened(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children of nodes a (of n children in all) with b."""
    children = (a[:, None] * FAN + np.arange(FAN)).ravel()
    inside = children < n
    return children[inside], np.repeat(b, FAN)[inside]


def pairs_between(one: list[np.ndarray], two: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (rep, rep) within one branch, or between two. A branch: rep, root, size, bits (an object array of bytes), in the order of the tree.

    Bitmaps of one width are one tree. Widths further apart than one step hold no links: sizes differ by more than the threshold allows.
    """
    trees: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    for branch in (one,) if two is None else (one, two):
        widths = np.fromiter(map(len, branch[3]), np.int64, len(branch[3]))
        by = {}
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            by[width] = at, np.frombuffer(b"".join(branch[3][at]), np.uint64).reshape(len(at), width // 8)
        trees.append(by)
    two_branch = one if two is None else two
    for width, (at, words) in trees[0].items():
        for other in (width // 2, width, 2 * width):
            if other not in trees[-1] or (two is None and other < width):
                continue
            narrow = min(width, other) // 8
            left = Nodes(folded(words, narrow), one[2][at], one[1][at])
            if two is None and other == width:
                right, at_b = left, at
            else:
                at_b, words_b = trees[-1][other]
                right = Nodes(folded(words_b, narrow), two_branch[2][at_b], two_branch[1][at_b])
            for a, b in traverse(left, right):
                yield one[0][at[a]], two_branch[0][at_b[b]]


_PLACED = ["key", "branch", "rep", "root", "n_shingles", "bits", "other", "earlier"]



def _first_met(pairs: tuple[np.ndarray, np.ndarray], row: dict[int, int], earlier: list) -> tuple[np.ndarray, np.ndarray]:
    """pairs (rep, rep) less those that a tree before this one has as well: they are found there. row: the place of each set in earlier, its trees before this one (all or some of them)."""
    at_a, at_b = (map(row.__getitem__, x.tolist()) for x in pairs)
    first = np.fromiter((earlier[i].isdisjoint(earlier[j]) for i, j in zip(at_a, at_b, strict=True)), bool, len(pairs[0]))
    return pairs[0][first], pairs[1][first]


def _candidates(rows: pa.Table) -> pa.Table:
    """Candidates of the branches in rows (_PLACED): within each branch, or, of two branches of one tree, between them. A pair that several trees have comes from the first of them, as far as earlier tells."""
    rows = rows.sort_by([("key", "ascending"), ("branch", "ascending"), ("other", "ascending"), ("n_shingles", "ascending"), ("rep", "ascending")])
    key, branch, rep, root, size = (rows[c].to_numpy() for c in _PLACED[:5])
    bits = np.array(rows["bits"].to_pylist(), object)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (branch[1:] != branch[:-1])])) if len(key) else np.empty(0, np.int64)
    ends = [*starts[1:], len(key)]
    pieces = [[x[i:j] for x in (rep, root, size, bits)] for i, j in zip(starts, ends, strict=False)]
    if len(pieces) == 2 and key[0] == key[-1]:
        groups = [(0, len(key), pairs_between(*pieces))]
    else:
        groups = [(i, j, pairs_between(piece)) for i, j, piece in zip(starts, ends, pieces, strict=False)]
    found = []
    for i, j, pairs in groups:
        row = earlier = None
        for pair in pairs:
            if row is None:
                row = {r: n for n, r in enumerate(rep[i:j].tolist())}
                earlier = list(map(frozenset, rows["earlier"].slice(i, j - i).to_pylist()))
            found.append(_first_met(pair, row, earlier))
    a, b = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
    return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _across(rows: pa.Table) -> pa.Table:
    """Candidates between two branches of a tree, in rows (_PLACED); earlier also holds all large trees of the set that precede this one."""
    if len(rows["branch"].unique()) < 2:
        rows = rows.slice(0, 0)
    return _candidates(rows.select(_PLACED))


def _branch_nodes(rows: pa.Table) -> pa.Table:
    """The node above each branch in rows: key, branch, least, most, excess, root (-1: several), bits (cut to the narrowest)."""
    out = []
    key, branch, root, size = (rows[c].to_numpy() for c in ("key", "branch", "root", "n_shingles"))
    bits = rows["bits"].to_pylist()
    for k, t in sorted(set(zip(key.tolist(), branch.tolist(), strict=True))):
        at = np.flatnonzero((key == k) & (branch == t))
        width = min(len(bits[i]) for i in at) // 8
        words = np.concatenate([folded(np.frombuffer(bits[i], np.uint64)[None], width) for i in at])
        excess = int((size[at] - np.bitwise_count(words).sum(axis=1, dtype=np.int64)).max())
        roots = np.unique(root[at])
        out.append((k, t, int(size[at].min()), int(size[at].max()), excess, int(roots[0]) if len(roots) == 1 else -1, np.bitwise_or.reduce(words).tobytes()))
    kinds = [pa.int64()] * 6 + [pa.binary()]
    columns = list(zip(*out, strict=True)) or [[]] * 7
    return pa.table([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["key", "branch", "least", "most", "excess", "root", "bits"])


def _like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of (a, b, n_a, n_b, bits_a, bits_b) that may be links by their bitmaps."""
    for batch in batches:
        keep = []
        for n_a, n_b, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            x, y = (np.frombuffer(w, np.uint64)[None] for w in (x, y))
            narrow = min(x.shape[1], y.shape[1])
            x, y = folded(x, narrow), folded(y, narrow)
            one, two, both = (int(np.bitwise_count(w).sum()) for w in (x, y, x & y))
            shared = min(n_a - one, n_b - two) + both
            keep.append(100 * shared >= THRESHOLD * (n_a + n_b - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of branches (key, x, y with their nodes) that may hold a link: as in may_link()."""
    for batch in batches:
        keep = []
        for r in batch.to_pylist():
            x, y = r["x"], r["y"]
            words = [np.frombuffer(n["bits"], np.uint64)[None] for n in (x, y)]
            narrow = min(w.shape[1] for w in words)
            # cut bitmaps have more shingles on a used bit than the wider ones had: the sizes bound them then
            excess = [n["excess"] if w.shape[1] == narrow else n["most"] for n, w in zip((x, y), words, strict=True)]
            bits = int(np.bitwise_count(folded(words[0], narrow) & folded(words[1], narrow)).sum())
            shared = min(min(excess) + bits, x["most"], y["most"])
            keep.append(100 * shared >= THRESHOLD * (x["least"] + y["least"] - shared))
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "one": batch.column("x").field("branch"), "two": batch.column("y").field("branch")}).filter(pa.array(keep, pa.bool_()))


def _entries(fronts: DataFrame) -> DataFrame:
    return fronts.select("rep", F.explode("front").alias("key"))


def _counts(entries: DataFrame) -> DataFrame:
    """(key, count) of the shingles that several rows have in front (rep, key); copies count each, which costs nothing: what only copies share is dropped in _trees()."""
    return materialize(entries.groupBy("key").count().where(F.col("count") > 1), "shared")


def _trees(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, rep, met): the sets of each tree. met: how many the tree has. Shingles of one set alone are no tree; of those with the same sets one stays."""
    # the side of the counts is far smaller than the entries: it is hashed, and nothing is sorted
    held = materialize(entries.join(counts.select("key").hint("shuffle_hash"), "key").distinct(), "entries")
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(k))) for k in (1, 2)]
    trees = held.groupBy("key").agg(F.count("*").alias("met"), marks[0].alias("m1"), marks[1].alias("m2")).where("met > 1")
    single = trees.groupBy("met", "m1", "m2").agg(F.min("key").alias("key")).select("key", "met")
    return materialize(held.join(single, "key"), "members")


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each set of rows (signed()): rep, least (smallest doc_id), t (hash of that row's text), n_shingles."""
    per = rows.where("n_shingles > 0 and doc_id is not null").groupBy("rep").agg(F.min(F.struct("doc_id", "t", "n_shingles")).alias("r"))
    return materialize(per.select("rep", F.col("r.doc_id").alias("least"), F.col("r.t").alias("t"), F.col("r.n_shingles").alias("n_shingles")), "classes")


def _held(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, text) of the classes in reps (rep): texts with the class's set, repeated rows each."""
    ids = classes.join(reps.distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), F.col("least").alias("_d"), F.col("t").alias("_t"))
    return docs.join(small(ids, MAX_BROADCAST_IDS), (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_t"))).select("id", "text")


def _texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the classes in pairs (a, b), a row each."""
    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    return materialize(_held(docs, classes, reps).dropDuplicates(["id"]), "texts")


def _sized(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members with n_shingles, less those of which no other set of their tree has a size near enough. Trees of more than MAX_SORTED sets stay as they are."""
    rows = members.join(classes.select("rep", "n_shingles"), "rep")
    w = Window.partitionBy("key").orderBy("n_shingles", "rep")
    before, after = F.lag("n_shingles").over(w), F.lead("n_shingles").over(w)
    near = (100 * before >= THRESHOLD * F.col("n_shingles")) | (100 * F.col("n_shingles") >= THRESHOLD * after)
    kept = rows.where(F.col("met") <= MAX_SORTED).withColumn("_near", near).where("_near").drop("_near")
    return kept.unionByName(rows.where(F.col("met") > MAX_SORTED))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [shingle_set(words_of(text.as_py()), hashes) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["key"])


def _reordered(docs: DataFrame, fronts: DataFrame, classes: DataFrame, seen: DataFrame) -> DataFrame:
    """(rep, front) of fronts with common shingles behind the others. seen: (key, count) of the common ones in front.

    Sets with a common shingle in front are read again whole: all shingles that are common among them are moved back, the most common ones last.
    """
    hit = _entries(fronts).join(small(seen.select("key"), MAX_COMMON), "key", "left_semi").select("rep")
    texts = materialize(_held(docs, classes, hit).dropDuplicates(["id"]), "common-texts")
    often = texts.select("text").mapInArrow(_shingles, "key long").groupBy("key").count().where(F.col("count") > COMMON_SETS)
    top = often.orderBy(F.desc("count"), "key").limit(MAX_COMMON).collect()  # a bounded list
    common = np.array([r["key"] for r in reversed(top)], np.int64).view(np.uint64)
    moved = materialize(signed(texts.withColumnRenamed("id", "doc_id"), common).select(F.col("doc_id").alias("rep"), "front"), "moved")
    discard(texts)
    return fronts.join(moved.select("rep"), "rep", "left_anti").unionByName(moved)


def _split(placed: DataFrame) -> DataFrame:
    """(key, main, n_main, n) of the trees of placed (key, root, ...) with several components: the largest one, its sets, and all sets."""
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    trees = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    return trees.select("key", F.col("m.root").alias("main"), F.col("m.n").alias("n_main"), "n")


def _without_loners(docs: DataFrame, classes: DataFrame, placed: DataFrame, families: DataFrame) -> DataFrame:
    """placed less the sets of families (key) that cannot be linked with any other of them, as over a fifth of their shingles are their own: no other set of any family has these."""
    mine = placed.join(families, "key", "left_semi")
    texts = materialize(_held(docs, classes, mine.select("rep")).dropDuplicates(["id"]), "family-texts")
    own = own_shingles(texts).where("u > 0")
    kept = mine.join(own, "rep", "left").where(f"100 * (n_shingles - coalesce(u, 0)) >= {THRESHOLD} * n_shingles").drop("u")
    return materialize(kept.unionByName(placed.join(families, "key", "left_anti")), "placed")


def _numbered(dealt: DataFrame) -> DataFrame:
    """dealt with at as the place in the whole order, from 0; given: the place in a partition, whose number is in the high bits."""
    part = F.shiftright("at", 33).alias("part")
    # one row for each partition
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = dealt.groupBy(part).agg(F.count("*").alias("rows"), F.min("at").alias("first")).select("part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return dealt.withColumn("part", part).join(F.broadcast(runs), "part").withColumn("at", F.col("at") - F.col("first") + F.col("before")).drop("part", "first", "before")


def links_of(found: DataFrame) -> DataFrame:
    return found.where(100 * F.col("common") >= THRESHOLD * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text; other columns are not read).

    Words are compared with A-Z in lower case. A text without words (null, empty, blank) is linked
    with nothing and is its own component. Repeated rows and copies share a component; rows of one
    doc_id with different texts are linked each by its own text. A row whose doc_id is null takes part
    through equal sets only: it gets the component of one that has an id, else null.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _jaccard_classes(docs)


def _jaccard_classes(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(signed(docs), "sets")
    classes = _classes(rows)
    fronts = rows.where("n_shingles > 0 and doc_id is not null").select("rep", "front")
    counts = _counts(_entries(fronts))
    common = counts.where(F.col("count") > COMMON_SETS)
    if not common.isEmpty():
        fronts = _reordered(docs, fronts, classes, common)
        counts = _counts(_entries(fronts))
    members = materialize(_sized(_trees(_entries(fronts), counts), classes), "sized")
    bits = materialize(rows.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "bits").dropDuplicates(["rep"]), "bitmaps")

    # each set of a larger tree, and the one that meets most others in its largest tree
    met = members.groupBy("rep", "n_shingles").agg(F.sum("met").alias("all"), F.max_by("key", F.struct("met", "key")).alias("key"), F.max("met").alias("most")).where(F.col("most") > FAN)
    hubs = members.join(met.select("rep", "all"), "rep").groupBy("key").agg(F.max_by(F.struct(F.col("rep").alias("hub"), F.col("n_shingles").alias("n_hub")), F.struct("all", -F.col("rep"))).alias("h")).select("key", "h.*")
    stars = met.join(hubs, "key").where(f"rep <> hub and 100 * least(n_shingles, n_hub) >= {THRESHOLD} * greatest(n_shingles, n_hub)")
    stars = stars.join(bits, "rep").join(bits.select(F.col("rep").alias("hub"), F.col("bits").alias("bits_hub")), "hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), F.col("n_hub").alias("n_a"), F.col("n_shingles").alias("n_b"), F.col("bits_hub").alias("bits_a"), F.col("bits").alias("bits_b"))
    stars = materialize(stars.mapInArrow(_like, "a long, b long"), "stars")
    links = materialize(links_of(overlaps(stars, _texts(docs, classes, stars))), "star-links")

    roots = connected_components(links).select(F.col("node").alias("rep"), "root")
    placed = members.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # trees with several components; the largest of each comes first, then the others by size
    split = _split(placed)
    families = materialize(split.where(f"n >= {FAMILY} and 2 * n_main >= n").select("key"), "families")
    if not families.isEmpty():
        placed = _without_loners(docs, classes, placed, families)
        split = _split(placed)
    placed = placed.join(split.select("key", "main"), "key").select("key", "rep", "root", "n_shingles", (F.col("root") != F.col("main")).alias("other"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "other", "n_shingles", "rep"]
    placed = materialize(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    # sets get their bitmaps when their branch is known, so that these are moved once
    placed = materialize(_numbered(placed).withColumn("branch", F.floor(F.col("at") / BRANCH)).drop("at"), "branches")
    # a pair leaves the first tree it is in only: what the first few trees of both sets tell is enough for nearly all
    firsts = materialize(placed.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_TREES).alias("firsts")), "first-trees")
    told = F.filter("firsts", lambda tree: tree < F.col("key"))
    sets = placed.join(bits, "rep").join(firsts, "rep").withColumn("earlier", told)
    inside = sets.select(*_PLACED).groupBy("branch").applyInArrow(_candidates, "a long, b long")

    # trees of several branches
    spans = placed.groupBy("key").agg(F.min("branch").alias("low"), F.max("branch").alias("high")).where("low < high").select("key")
    large = materialize(sets.join(spans, "key").select(*_PLACED), "large-trees")
    nodes = large.groupBy("branch").applyInArrow(_branch_nodes, "key long, branch long, least long, most long, excess long, root long, bits binary")
    nodes = materialize(nodes, "branch-nodes")
    x, y = (nodes.select("key", F.struct(*nodes.columns[1:]).alias(side)) for side in "xy")
    fits = x.join(y, "key").where("x.branch < y.branch and not (x.root = y.root and x.root <> -1)").where(f"100 * x.most >= {THRESHOLD} * y.least and 100 * y.most >= {THRESHOLD} * x.least")
    fits = materialize(fits.mapInArrow(_fitting, "key long, one long, two long").withColumn("task", F.monotonically_increasing_id()), "branch-pairs")
    sides = fits.select("task", "key", F.explode(F.expr("array(struct(one as branch, two as beside), struct(two as branch, one as beside))")).alias("s")).select("task", "key", "s.*")
    sides = sides.join(nodes.select("key", F.col("branch").alias("beside"), "least", "most", F.col("root").alias("root_beside")), ["key", "beside"])
    # a set goes to the tasks in which the branch beside its own has another component and a size near enough
    meets = f"root <> root_beside and 100 * most >= {THRESHOLD} * n_shingles and 100 * n_shingles >= {THRESHOLD} * least"
    trees = large.groupBy("rep").agg(F.collect_list("key").alias("trees"))
    met = large.join(sides, ["key", "branch"]).where(meets).join(trees, "rep").withColumn("earlier", F.array_union("earlier", F.filter("trees", lambda tree: tree < F.col("key"))))
    across = met.select("task", *_PLACED).groupBy("task").applyInArrow(_across, "a long, b long")

    found = materialize(inside.unionAll(across).distinct(), "candidates")
    links = materialize(links.unionAll(links_of(overlaps(found, _texts(docs, classes, found)))), "links")
    discard(large)

    roots = connected_components(links).select(F.col("node").alias("rep"), "root")
    named = classes.select("rep", "least").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = materialize(named.join(least, "root").select("rep", "component"), "components")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "rep", "n_shingles").join(named, "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"))
