"""MinHash near-duplicate classes (operator 3).

Each text's set of word shingles gets 128 minima, made of one pass of multiplicative permutations
over 64-bit shingle hashes. 32 bands of 4 whole minima give the candidates; of each minimum only
the two low bits are kept, packed into four longs, and a candidate must reach a
collision-corrected similarity of SLACK by bit counts before both texts are fetched and the link is
confirmed on the full sets. A pair at similarity 0.75 shares no band with probability
(1 - 0.75**4)**32 = 5e-6, and falls short of SLACK with probability below 1e-7.

Copies are folded first: the texts of one word sequence (by its 128-bit hash) are a class, which
costs one row and is named by its smallest doc_id. In a bucket, members are compared with its hub, the member that meets most others in all its
buckets (round 1), and components are formed. Of the pairs that still lie in different components
(round 2), one can only be a link if

    100 * m >= 75 * (n_a + n_b - m),   m = min(h_a, h_b) + min(n_a - h_a - u_a, n_b - h_b - u_b)

where n is the size of a set, h what it shares with the bucket's hub, and u counts its shingles that
no other text of these buckets has: m is an exact bound of the intersection. So a large group of near copies costs rows in
proportion to its size, yet no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, arrow_rows, column, discard, materialize, row_hash, small, spare
from .graph import connected_components

SHINGLE, BANDS, ROWS = 5, 32, 4
THRESHOLD, SLACK = 75, 0.5
#: Documents whose ids may be broadcast to pick their texts (8 bytes each); beyond it the join is shuffled.
MAX_BROADCAST_IDS = 2_000_000
#: Pairs of one hub that a task compares, about.
PAIRS_EACH = 256
#: Rows in an Arrow batch: whole texts, in pairs.
BATCH_ROWS = 500
_MASK = (1 << 64) - 1


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PERMUTATIONS = _odd(BANDS * ROWS, 17)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of SHINGLE words; of the whole sequence if it is shorter; empty without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += h[j : n - k + 1 + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation, in blocks, so that a long text needs little memory."""
    out = np.full(len(_PERMUTATIONS), _MASK, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[None, at : at + 2048] * _PERMUTATIONS).min(axis=1), out=out)
    return out


def pack_low_bits(lows: np.ndarray) -> np.ndarray:
    """128 minima -> 4 longs of 32 two-bit lanes."""
    lanes = (lows & np.uint64(3)).reshape(4, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(lanes, axis=1).view(np.int64)


def band_keys(lows: np.ndarray) -> np.ndarray:
    rows = lows.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for j in range(ROWS):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + rows[:, j]
    return (out ^ (out >> np.uint64(30))).view(np.int64)


_SIGNATURE = "doc_id long, t long, c1 long, c2 long, n_shingles long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        n = batch.num_rows
        classes, sizes = np.zeros((n, 2), np.int64), np.zeros(n, np.int64)
        packed, bands = np.zeros((n, 4), np.int64), np.zeros((n, BANDS), np.int64)
        for i, text in enumerate(batch.column(2)):
            words = words_of(text.as_py())
            shingles = shingle_set(words, hashes)
            sizes[i] = len(shingles)
            if len(shingles):
                classes[i] = np.frombuffer(xxhash.xxh128_digest(b" ".join(words)), np.int64)
                lows = minima(shingles)
                packed[i], bands[i] = pack_low_bits(lows), band_keys(lows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x) for x in (classes[:, 0], classes[:, 1], sizes)), *(pa.array(packed[:, k]) for k in range(4)), lists],
            names=["doc_id", "t", "c1", "c2", "n_shingles", "s0", "s1", "s2", "s3", "bands"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), class of the word sequence (c1, c2), n_shingles, packed two-bit minima (s0..s3) and band keys."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(_sign, _SIGNATURE)


def estimate(a: str, b: str) -> F.Column:
    """Similarity by bit counts: equal two-bit lanes, less the quarter that agrees by chance."""
    unequal = sum(
        (F.bit_count((x := F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for k in range(4)),
        start=F.lit(0),
    )
    return (F.lit(1.0) - unequal / F.lit(float(BANDS * ROWS)) - F.lit(0.25)) / F.lit(0.75)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, last = WordHashes(), (None, None)
    for batch in batches:
        found = np.zeros((batch.num_rows, 3), np.int64)
        for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = a.as_py(), b.as_py()
            if a != last[0]:
                last = (a, shingle_set(words_of(a), hashes))
            one, two = last[1], shingle_set(words_of(b), hashes)
            found[i] = len(one), len(two), len(np.intersect1d(one, two, assume_unique=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(3))], names=["a", "b", "n_a", "n_b", "common"])


def overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common): sizes of the full shingle sets of pairs (a, b), and of their intersection.

    The pairs of one a (a hub may have any number of them) are dealt to several tasks, PAIRS_EACH or so to each; its text is sent to as many.
    """
    each = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_EACH).cast("int").alias("parts"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(each, "a")
    left = left.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    dealt = pairs.join(each, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    return dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "text_a", "text_b").mapInArrow(_overlap, "a long, b long, n_a long, n_b long, common long")


def links_of(found: DataFrame) -> DataFrame:
    return found.where(100 * F.col("common") >= THRESHOLD * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = shingle_set(words_of(text.as_py()), hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name)), pa.array(found)], names=["rep", "h"])


def own_shingles(texts: DataFrame) -> DataFrame:
    """(rep, u): how many shingles of a text (id, text) none of the other texts has; texts without such a shingle do not appear."""
    rows = texts.select("id", "text").mapInArrow(_shingles, "rep long, h long")
    single = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1")
    return single.groupBy("rep").agg(F.count("*").alias("u"))


def _classes(signed: DataFrame) -> DataFrame:
    """One row for each word sequence: c1, c2, rep (its name), least (its smallest doc_id), t (the hash of that row's text), n_shingles, s0..s3, bands.

    rep is least, unless rows of one doc_id have different texts: of the classes that share their
    least, all but one are then named by a negative hash.
    """
    per = signed.where("n_shingles > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min_by(F.struct("doc_id", "t", "n_shingles", "s0", "s1", "s2", "s3", "bands"), F.struct("doc_id", "t")).alias("r"))
    per = materialize(per.select("c1", "c2", "r.*").withColumnRenamed("doc_id", "least"), "classes")
    shared = per.groupBy("least").agg(F.count("*").alias("n"), F.min(F.struct("c1", "c2")).alias("first")).where("n > 1").select("least", "first")
    named = per.join(small(shared, MAX_BROADCAST_IDS), "least", "left")
    other = F.col("first").isNotNull() & (F.struct("c1", "c2") != F.col("first"))
    return named.withColumn("rep", F.when(other, F.xxhash64("c1", "c2").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("least"))).drop("first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are not read).

    Words are compared with A-Z in lower case. A text without words (null, empty, blank) is linked
    with nothing. Repeated rows and copies share a component; rows of one doc_id with different texts
    are linked each by its own text. A row whose doc_id is null takes part
    through its copies only: it gets the component of an equal text that has an id, else null; it
    is kept if it has none.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(signatures(docs), "signatures")
    reps = _classes(signed)

    entries = reps.select("rep", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(entries.join(shared, "key"), "met")
    signs = reps.select("rep", "least", "t", "n_shingles", "s0", "s1", "s2", "s3").join(met.groupBy("rep").agg(F.sum("n").alias("met")), "rep")
    bands = reps.select("rep", "bands")
    signed_members = met.select("key", "rep").join(signs, "rep")
    # a bucket's hub comes with its signature, so that no task gathers the pairs of a hub
    hubs = signed_members.groupBy("key").agg(F.max_by(F.struct(F.col("rep").alias("hub"), "s0", "s1", "s2", "s3"), F.struct("met", -F.col("rep"))).alias("its"))
    members = materialize(signed_members.join(hubs, "key").withColumn("hub", F.col("its.hub")), "members")
    discard(met)
    ids = members.select(F.col("rep").alias("id"), F.col("least").alias("_d"), F.col("t").alias("_t")).distinct()
    # the text whose hash the class has kept: rows of one doc_id may have different texts
    held = docs.join(small(ids, MAX_BROADCAST_IDS), (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_t")))
    texts = materialize(held.select("id", "text").dropDuplicates(["id"]), "texts")

    stars = members.where("rep <> hub").dropDuplicates(["hub", "rep"]).select("hub", "rep", F.struct("s0", "s1", "s2", "s3").alias("x"), F.col("its").alias("y"))
    stars = stars.where(estimate("x", "y") >= SLACK).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    told = materialize(overlaps(materialize(stars, "stars"), texts), "overlaps")
    members = members.drop("its")
    links = links_of(told)

    roots = connected_components(links)
    placed = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("n_root"))
    mixed = counts.groupBy("key").agg(F.max_by("root", F.struct("n_root", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")
    placed = materialize(placed.join(mixed, "key"), "placed")
    alone = own_shingles(texts.join(placed.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    placed = placed.join(alone, "rep", "left").withColumn("u", F.coalesce("u", F.lit(0))).where(100 * (F.col("n_shingles") - F.col("u")) >= THRESHOLD * F.col("n_shingles"))
    placed = placed.join(bands, "rep")
    at_hub = told.select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.col("common").alias("h"))
    placed = materialize(placed.join(at_hub, ["hub", "rep"], "left"), "placed")
    x, y = placed.where("root <> main").alias("x"), placed.alias("y")
    n, u, h = (lambda t: F.col(f"{t}.n_shingles")), (lambda t: F.col(f"{t}.u")), (lambda t: F.col(f"{t}.h"))
    inside = F.least(h("x"), h("y")) + F.least(n("x") - h("x") - u("x"), n("y") - h("y") - u("y"))
    most = F.coalesce(F.when(h("x").isNotNull() & h("y").isNotNull(), inside), F.least(n("x") - u("x"), n("y") - u("y")))
    across = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.root") != F.col("y.root"))
        & ((F.col("y.root") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        & (F.col("x.rep") != F.col("x.hub"))
        & (F.col("y.rep") != F.col("y.hub"))
        & (100 * most >= THRESHOLD * (n("x") + n("y") - most))
        & (estimate("x", "y") >= SLACK)
        # of the buckets that both share, the first one gives the pair
        & (F.col("x.key") == F.array_min(F.array_intersect("x.bands", "y.bands"))),
    )
    across = materialize(across.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), "across")
    links = materialize(links.union(links_of(overlaps(across, texts))), "links")

    roots = connected_components(links).withColumnRenamed("node", "rep")
    classes = materialize(reps.select("c1", "c2", "rep", "least").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "roots")
    # a root that is a name, not a doc_id: the smallest doc_id among its classes
    named = classes.where("root < 0").groupBy("root").agg(F.min("least").alias("low"))
    classes = classes.join(small(named, MAX_BROADCAST_IDS), "root", "left").select("c1", "c2", F.coalesce("low", "root").alias("component"))
    rows = signed.select("doc_id", "c1", "c2", "n_shingles").join(classes, ["c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, any other columns) that stay when each group of near duplicates keeps one document, that of the smallest doc_id.

    Of repeated rows (one doc_id, one text) the one with the smallest hash of all columns stays. Rows
    without a doc_id, and those whose doc_id has several texts, are linked like all others, each by
    its own text; in the order they stand behind the rest, by a hash of doc_id and text. Texts
    without words all stay.
    """
    text, own = F.col("text").cast("string"), spare(docs)
    number, words, row, several_of, kept_of = f"{own}number", f"{own}words", f"{own}row", f"{own}several", f"{own}kept"
    columns = list(map(column, docs.columns))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t")).where("doc_id is not null")
    several = ids.groupBy("doc_id").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select(F.col("doc_id").alias(several_of))
    marked = docs.join(small(several, MAX_BROADCAST_IDS), F.col("doc_id").cast("long") == F.col(several_of), "left")
    behind = F.shiftrightunsigned(F.xxhash64("doc_id", text), 2).bitwiseOR(F.lit(1 << 62))
    named = F.when(F.col(several_of).isNull() & F.col("doc_id").isNotNull(), F.col("doc_id").cast("long")).otherwise(behind)
    numbered = marked.select(*columns, named.alias(number), F.coalesce(F.regexp(text, F.lit(WORD)), F.lit(False)).alias(words))
    kept = near_duplicates(numbered.where(F.col(words)).select(F.col(number).alias("doc_id"), text.alias("text"))).where("kept").select(F.col("doc_id").alias(kept_of)).distinct()
    blank = numbered.where(~F.col(words)).select(*columns)
    same = Window.partitionBy(number).orderBy(row_hash(docs))
    first = numbered.where(F.col(words)).join(kept, F.col(number) == F.col(kept_of), "left_semi").withColumn(row, F.row_number().over(same)).where(F.col(row) == 1)
    return first.select(*columns).unionAll(blank)
