"""What the two text classifiers share: hashed n-grams of a word, a cache of word scores, labelled samples, calibration."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Words whose scores a worker keeps at a time.
CACHED_WORDS = 1 << 17


def ngram_buckets(words: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word numbers) of the byte n-grams of <word>, and of the word itself, for all words at once."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.cumsum(lengths)[word] - np.arange(len(data))  # bytes from here to the end of the word
    buckets, owners = [np.fromiter(map(crc32, words), np.int64, len(words)) & (BUCKETS - 1)], [np.arange(len(words))]
    h = np.zeros(len(data), np.uint64)
    for k in range(max(sizes)):
        h = h * np.uint64(0x100000001B3)
        h[: len(data) - k] += data[k:] + np.uint64(1)
        if k + 1 in sizes:
            whole = left > k
            mixed = (h[whole] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            owners.append(word[whole])
    return np.concatenate(buckets), np.concatenate(owners)


class WordScores:
    """Sums of table rows over a word's n-grams, with the number of n-grams last; kept for words seen lately."""

    def __init__(self, table: np.ndarray, sizes: tuple[int, ...]):
        self.table, self.sizes, self.index = table, sizes, {}
        self.rows = np.zeros((CACHED_WORDS, table.shape[1] + 1), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Sum of the rows of all words, taken in blocks so that a long text needs little memory."""
        total = np.zeros(self.rows.shape[1], np.float64)
        for at in range(0, len(words), 50_000):
            total += self._block(words[at : at + 50_000])
        return total

    def _block(self, block: list[bytes]) -> np.ndarray:
        index = self.index
        if len(index) + len(block) > CACHED_WORDS:
            index.clear()
        new = [w for w in dict.fromkeys(block) if w not in index]
        if new:
            at = len(index)
            index.update(zip(new, range(at, at + len(new)), strict=True))
            buckets, owners = ngram_buckets(new, self.sizes)
            for c in range(self.table.shape[1]):
                self.rows[at : at + len(new), c] = np.bincount(owners, weights=self.table[buckets, c], minlength=len(new))
            self.rows[at : at + len(new), -1] = np.bincount(owners, minlength=len(new))
        ids = np.fromiter(map(index.__getitem__, block), np.int64, len(block))
        return self.rows[ids].sum(axis=0, dtype=np.float64)


def sampled(rows: DataFrame, keys: list[str], at_most: int, seed: int) -> DataFrame:
    """at_most rows of rows (all, if there are fewer): those of the smallest hashes of keys, then of the smallest keys, so that neither files nor retries matter. Each task keeps at_most rows at most."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(at_most)


def sampled_each(rows: DataFrame, group: str, keys: list[str], at_most: int, seed: int) -> DataFrame:
    """at_most rows of each group (all of a smaller one), those of the smallest hashes of keys. group must not be null.

    A hash bound from the group's count leaves few rows of a large group before they are ordered.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))  # a row for each group
    spare = F.lit(float(2 * at_most + 100)) / F.col("_n") * F.lit(float(1 << 32))
    picked = rows.withColumn("_hash", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 32))).join(F.broadcast(counts), group).where(F.col("_hash") < spare)
    place = F.row_number().over(Window.partitionBy(group).orderBy("_hash", *keys))
    return picked.withColumn("_place", place).where(F.col("_place") <= at_most).select(*rows.columns)


def give_back() -> None:
    """Returns freed memory to the system, so that a driver that trained something does not keep it."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(blocks: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> float:
    """The temperature of least log loss on n rows that were not fitted, given as blocks (logits, gold); of n rows one more is taken to be wrong, so that few rows never make a score certain."""
    if not n:
        return 1.0
    wrong = 1 / (n + 2)
    grid = np.geomspace(0.25, 8, 61)
    losses = np.zeros(len(grid))
    for logits, gold in blocks:
        target = np.full(logits.shape, wrong / max(1, logits.shape[1] - 1))
        target[np.arange(len(gold)), gold] = 1 - wrong
        losses += [-(target * np.log(np.maximum(softmax(logits / t), 1e-12))).sum() for t in grid]
    return float(grid[int(np.argmin(losses))])
