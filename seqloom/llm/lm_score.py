"""Cross-entropy difference of two n-gram models (operator 1).

Words (A-Z lower-cased) and pairs of neighbouring words are counted over all documents, once for the
background (every row) and once for the target rows. A pair's probability is its count, smoothed by
STRENGTH expected counts of the second word's own probability, which is smoothed by one count for each
word of the corpus and one for the unknown. Every word and every pair counts, however rare, so the
models grow with the corpus; they are never collected or broadcast. What a document itself added to
the counts is taken off before it is scored by either model, so a target document is not known to the
target model by its own words, and a score tells likeness rather than membership.

Documents are encoded once, in chunks of about CHUNK_WORDS words. A chunk asks for the counts of its
distinct words and pairs (63-bit hashes, so two different ones are taken for one about once in 2^63
pairs of them); what it asks is dealt by ranges of the hash to buckets, which sum up the counts of all
chunks and answer each. A word or pair, however common, is one entry for each chunk it occurs in. The
losses of a chunk's documents are then taken from its answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_rows, materialize, small

STRENGTH = 32.0
#: Words in a chunk (whole documents, so a longer one makes a longer chunk), and words of the corpus for each bucket.
CHUNK_WORDS, BUCKET_WORDS = 1 << 18, 1 << 19
#: Rows in an Arrow batch of whole texts, and of chunks.
BATCH_ROWS, BATCH_CHUNKS = 2_000, 2
_START, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
_CHUNK = "chunk long, n long, n_target long, starts long, starts_target long, doc_ids array<long>, lengths array<long>, targets array<boolean>, hashes binary, ids binary"


def packed(x: np.ndarray) -> bytes:
    """The bytes of integers, first bytes first, compressed: high bytes are nearly always 0. The rows of these tables are mostly hashes and counts, which are large otherwise."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    found = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(found.reshape(width, n).T).view(kind).ravel()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Vocabulary(dict):
    """word -> number in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        ids = np.concatenate([*held, np.empty(0, "<i4")])
        hashes = np.fromiter(map(xxh64_intdigest, vocabulary), "<u8", len(vocabulary))
        n, target = np.array(lengths, np.int64), np.array(targets, bool)
        totals = (len(ids), int(n[target].sum()), int((n > 0).sum()), int((n[target] > 0).sum()))
        row = (TaskContext.get().partitionId() << 32 | made, *totals, doc_ids, lengths, targets, hashes.tobytes(), packed(ids))
        kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["chunk", "n", "n_target", "starts", "starts_target", "doc_ids", "lengths", "targets", "hashes", "ids"])

    vocabulary, held, doc_ids, lengths, targets, size, made = Vocabulary(), [], [], [], [], 0, 0
    for batch in batches:
        for doc_id, text, target in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = words_of(text.as_py())
            held.append(np.fromiter(map(vocabulary.__getitem__, words), "<i4", len(words)))
            doc_ids.append(doc_id)
            lengths.append(len(words))
            targets.append(bool(target))
            size += len(words) + 1
            if size >= CHUNK_WORDS:
                yield out()
                vocabulary, held, doc_ids, lengths, targets, size, made = Vocabulary(), [], [], [], [], 0, made + 1
    if doc_ids:
        yield out()


class Chunk:
    """What a chunk's row holds. before, word: numbers of the words of each distinct pair, before is the number of words at the start of a text; at: the pair of each position.

    keys: of the words, and of the pairs; the lowest bit tells which.
    """

    def __init__(self, row: dict):
        self.doc_ids, self.lengths, self.targets = row["doc_ids"], np.array(row["lengths"], np.int64), np.array(row["targets"], bool)
        hashes, self.ids = np.frombuffer(row["hashes"], "<u8"), unpacked(row["ids"], "<i4").astype(np.int64)
        v = self.n_words = len(hashes)
        ends = np.cumsum(self.lengths)
        first = np.empty_like(self.ids)
        first[1:] = self.ids[:-1]
        first[(ends - self.lengths)[self.lengths > 0]] = v
        self.ends = ends[self.lengths > 0] - 1
        pairs, self.at = np.unique(first * (v + 1) + self.ids, return_inverse=True)
        self.before, self.word = pairs // (v + 1), pairs % (v + 1)
        known = np.append(hashes, _START)
        x = hashes[self.word]
        mixed = (known[self.before] * np.uint64(0xC2B2AE3D27D4EB4F) + (x << np.uint64(31) | x >> np.uint64(33))) * np.uint64(0x9FB21C651E98DF25)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.keys = np.concatenate([hashes & ~_PAIR, mixed | _PAIR])

    def counts(self) -> np.ndarray:
        """Of each key in this chunk: occurrences, those in target rows, and both at the end of a text (0 for pairs)."""
        target = np.repeat(self.targets, self.lengths)
        v, k = self.n_words, len(self.word)
        out = np.zeros((4, v + k), "<u4")
        for m, (inside, last) in enumerate(((slice(None), self.ends), (target, self.ends[target[self.ends]]))):
            out[m] = np.concatenate([np.bincount(self.ids[inside], minlength=v), np.bincount(self.at[inside], minlength=k)])
            out[m + 2, :v] = np.bincount(self.ids[last], minlength=v)
        return out

    def losses(self, n: np.ndarray, totals: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Sums of the losses in bits of each document, (background, target), by what the rest of the corpus holds. n: counts() of the corpus; totals, starts: its words, and its texts that have some."""
        v, k = self.n_words, len(self.word)
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        # own counts of each document: of its pairs, and of its words, all and but the last one
        own, own_pair = np.unique(doc * max(k, 1) + self.at, return_counts=True)
        doc, at = own // max(k, 1), own % max(k, 1)
        words, own_word = np.unique(np.repeat(np.arange(len(self.lengths)), self.lengths) * (v + 1) + self.ids, return_counts=True)
        own_before = own_word.copy()
        own_before[np.searchsorted(words, np.flatnonzero(self.lengths) * (v + 1) + self.ids[self.ends])] -= 1
        word, before = self.word[at], self.before[at]
        own_word = own_word[np.searchsorted(words, doc * (v + 1) + word)]
        # a text's first word has the start before it, which is in each text once
        own_before = np.where(before == v, 1, np.append(own_before, 0)[np.searchsorted(words, doc * (v + 1) + before)])
        out = []
        for m, inside in enumerate((np.ones(len(self.lengths), bool), self.targets)):
            mine = inside[doc].astype(float)
            n_word, n_pair = n[m, :v].astype(float), n[m, v:].astype(float)
            n_before = np.append(n_word - n[m + 2, :v], starts[m])
            p_word = (n_word[word] - mine * own_word + 1) / (totals[m] - mine * self.lengths[doc] + size)
            loss = -np.log2((n_pair[at] - mine * own_pair + STRENGTH * p_word) / (n_before[before] - mine * own_before + STRENGTH))
            out.append(np.bincount(doc, weights=own_pair * loss, minlength=len(self.lengths)))
        return np.array(out)


def encode(docs: DataFrame) -> DataFrame:
    """The chunks of all rows of docs (doc_id, text, is_target)."""
    return docs.select("doc_id", "text", "is_target").mapInArrow(_encode, _CHUNK)


def count(chunks: DataFrame, buckets: int) -> DataFrame:
    """The corpus's counts for each chunk and bucket: chunk, bucket, n_new (words that no other row counts), counts (four for each key of the chunk in this bucket, in the order of keys)."""
    cuts = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                order = np.argsort(chunk.keys)
                keys, n = chunk.keys[order], chunk.counts()[:, order]
                ends = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                spans = [(b, slice(i, j)) for b, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if j > i]
                told = [packed(np.diff(keys[s], prepend=np.uint64(0))) for _, s in spans], [packed(n[:, s].ravel()) for _, s in spans]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in spans], pa.int64()), pa.array([row["chunk"]] * len(spans), pa.int64()), *(pa.array(x, pa.binary()) for x in told)], names=["bucket", "chunk", "keys", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x.as_py(), "<u8"), dtype=np.uint64) for x in asked["keys"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([unpacked(x.as_py(), "<u4").reshape(4, -1) for x in asked["counts"]], axis=1)
        n = np.array([np.bincount(at, weights=x) for x in n]).astype("<i8")
        ends = np.cumsum([0, *map(len, keys)])
        told = pa.array([packed(n[:, at[i:j]].ravel()) for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
        new = [int(np.count_nonzero(every & _PAIR == 0)), *[0] * (len(keys) - 1)]
        return pa.table([asked["chunk"], asked["bucket"], pa.array(new, pa.int64()), told], names=["chunk", "bucket", "n_new", "counts"])

    asked = chunks.mapInArrow(ask, "bucket long, chunk long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, n_new long, counts binary")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (bits a word) and ce_difference (target less background: low is like the target) for every row of docs, by models of docs without the row itself.

    docs: doc_id, text, is_target. A copy of a row is another row. A null or blank text has no words and null losses. Whole texts are read.
    """
    spark = docs.sparkSession
    rows = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}  # a chunk is a large row
    with arrow_rows(spark, BATCH_ROWS):
        chunks = materialize(encode(docs), "chunks", **rows)
    totals, starts = np.array(chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_target", "starts", "starts_target"))).first(), float).reshape(2, 2)
    with arrow_rows(spark, BATCH_CHUNKS):
        counted = materialize(count(chunks, max(1, -(-int(totals[0]) // BUCKET_WORDS))), "counts", **rows)
    size = 1 + counted.agg(F.coalesce(F.sum("n_new"), F.lit(0))).first()[0]

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(rows.to_pylist()[0])
        answers = answers.sort_by("bucket")
        n = np.zeros((4, len(chunk.keys)), np.int64)
        n[:, np.argsort(chunk.keys)] = np.concatenate([np.zeros((4, 0), np.int64), *(unpacked(x.as_py(), "<i8").reshape(4, -1) for x in answers["counts"])], axis=1)
        lengths = chunk.lengths
        background, target = chunk.losses(n, totals, starts, size) / np.maximum(lengths, 1)
        told = [pa.array(x, pa.float64(), mask=lengths == 0) for x in (target, background, target - background)]
        return pa.table([pa.array(chunk.doc_ids, pa.int64()), pa.array(lengths), *told], names=["doc_id", "n_words", "target_loss", "background_loss", "ce_difference"])

    parts = chunks.groupBy("chunk").cogroup(counted.drop("n_new").groupBy("chunk"))
    return parts.applyInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double, ce_difference double")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, max_broadcast: int = 2_000_000) -> DataFrame:
    """score() of every row of docs; target rows are those whose doc_id is in targets (doc_id)."""
    ids = targets.select(F.col("doc_id").cast("long").alias("_t")).where("_t is not null").distinct()
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = marked.join(small(ids, max_broadcast), F.col("doc_id") == F.col("_t"), "left").select("doc_id", "text", F.col("_t").isNotNull().alias("is_target"))
    return score(marked)
