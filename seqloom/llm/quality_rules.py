"""Quality rules (operator 5): counting rules, and a calibrated logistic regression on hashed n-grams.

Features of a text are the hashed byte n-grams (3 to 5 bytes) of its words, its words, and its pairs of
neighbouring words, each as a mean over the text times SCALE. Weights are fitted by Adagrad on at most MAX_ROWS
labelled rows; a Platt scaling fitted on rows that were held back makes the score a probability.
Rows are scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .models import BUCKETS, WordScores, give_back, ngram_buckets, sampled

SIZES = (3, 4, 5)
MAX_ROWS, EPOCHS, RATE, SCALE = 3_000, 6, 0.05, 40.0
#: Fixed thresholds: fewest words, largest share of repeated words in percent, and the probability of good quality under which a text is rejected.
MIN_WORDS, MAX_REPEAT, KEEP_FROM = 50, 50, 0.5
_SYMBOL = re.compile(r"[#*$%&|<>]")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class WordIds(dict):
    """word -> 64-bit number for pairs; kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


def pair_buckets(h: np.ndarray) -> np.ndarray:
    return (((h[:-1] * _PAIR) ^ (h[1:] >> np.uint64(1))) * _PAIR >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def repeated_words(h: np.ndarray) -> int:
    """Words in three-word windows that are found twice or more; h: a 64-bit hash of each word."""
    if len(h) < 4:
        return 0
    windows = ((h[:-2] * _PAIR ^ (h[:-2] >> np.uint64(29))) + h[1:-1]) * _PAIR
    windows = (windows ^ (windows >> np.uint64(31))) * _PAIR + h[2:]
    _, index, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[index] > 1
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[j : j + len(twice)] |= twice
    return int(covered.sum())


def counts(text: str | None, ids: WordIds) -> tuple[list[bytes], np.ndarray, tuple[int, int, int, int, int]]:
    """Words, their hashes, and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if not text:
        return [], np.empty(0, np.uint64), (0, 0, 0, 0, 0)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    blanks = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    seen, repeated = set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            repeated += line in seen
            seen.add(line)
    return words, h, (len(words), len(text) - blanks, len(_SYMBOL.findall(text)), repeated, repeated_words(h))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT * n_words


def _features(text: str, ids: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and mean weights of the n-grams, and of the pairs."""
    words, h, _ = counts(text, ids)
    a, n = np.unique(np.concatenate([ngram_buckets(words[k : k + 50_000], SIZES)[0] for k in range(0, max(1, len(words)), 50_000)]), return_counts=True)
    b, m = np.unique(pair_buckets(h), return_counts=True) if len(h) > 1 else (np.empty(0, int), np.empty(0, int))
    share = lambda x: (SCALE * x / max(1, x.sum())).astype(np.float32)
    return a.astype(np.int32), share(n), b.astype(np.int32), share(m)


class Features:
    """Features of rows, one after another in a file of the driver, so that its memory does not grow with the length of their texts. A row: its buckets and weights of n-grams, then those of pairs."""

    def __init__(self):
        self._file, self._ends, self._kind = tempfile.TemporaryFile(), [(0, 0)], np.dtype([("at", "<i4"), ("share", "<f4")])
        self.gold: list[int] = []
        self._rows: np.ndarray | None = None

    def add(self, data: bytes, n_words: int, quality: int) -> None:
        """data: as feature_bytes() gives it."""
        self._file.write(data)
        start = self._ends[-1][1]
        self._ends.append((start + n_words, start + len(data) // self._kind.itemsize))
        self.gold.append(quality)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if self._rows is None:
            self._file.flush()
            self._rows = np.memmap(self._file, self._kind, "r") if self._ends[-1][1] else np.empty(0, self._kind)
        (_, start), (middle, end) = self._ends[k], self._ends[k + 1]
        words, pairs = self._rows[start:middle], self._rows[middle:end]
        return words["at"], words["share"], pairs["at"], pairs["share"]


def feature_bytes(text: str, ids: WordIds) -> tuple[bytes, int]:
    """Features of a text as (int32, float32) pairs, and how many of them are n-grams."""
    a, n, b, m = _features(text, ids)
    out = np.empty(len(a) + len(b), [("at", "<i4"), ("share", "<f4")])
    out["at"], out["share"] = np.concatenate([a, b]), np.concatenate([n, m])
    return out.tobytes(), len(a)


def train(rows: Iterable[tuple[str, int]], seed: int = 5, epochs: int = EPOCHS, rate: float = RATE) -> dict:
    """Model from (text, quality 0/1) rows. With rows of one class only, everything counts as that class. The same rows give the same model."""
    found = Features()
    for text, quality in rows:
        found.add(*feature_bytes(text, WordIds()), quality)
    return fit(found, seed, epochs, rate)


def fit(x: Features, seed: int = 5, epochs: int = EPOCHS, rate: float = RATE) -> dict:
    """Model from the features of rows."""
    rng = np.random.default_rng(seed)
    gold = np.array(x.gold, float)
    w, v, bias = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0
    if len(set(gold.tolist())) < 2:
        return {"words": w.astype(np.float32), "pairs": v.astype(np.float32), "bias": 0.0, "scale": 0.0, "shift": 8.0 if not len(gold) or gold[0] else -8.0}
    held = rng.random(len(gold)) < 0.25
    gw, gv, gb = np.full(BUCKETS, 1e-6), np.full(BUCKETS, 1e-6), 1e-6
    balance = {1.0: 0.5 / gold.mean(), 0.0: 0.5 / (1 - gold.mean())}
    for _ in range(epochs):
        for k in rng.permutation(np.flatnonzero(~held)):
            a, n, b, m = x[k]
            z = w[a] @ n + v[b] @ m + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - gold[k]) * balance[gold[k]]
            for weights, squares, at, value in ((w, gw, a, n), (v, gv, b, m)):
                g = error * value + 1e-6 * weights[at]
                squares[at] += g * g
                weights[at] -= rate * g / np.sqrt(squares[at])
            gb += error * error
            bias -= rate * error / np.sqrt(gb)
    model = {"words": w.astype(np.float32), "pairs": v.astype(np.float32), "bias": float(bias), "scale": 1.0, "shift": 0.0}
    z = np.array([w[a] @ n + v[b] @ m + bias for a, n, b, m in map(x.__getitem__, range(len(gold)))])
    return model | _platt(z[held], gold[held])


def _platt(z: np.ndarray, gold: np.ndarray) -> dict:
    """scale and shift of least log loss, by Newton steps with smoothed targets."""
    scale, shift = 1.0, 0.0
    up, down = (gold.sum() + 1) / (gold.sum() + 2), 1 / ((1 - gold).sum() + 2)
    target = np.where(gold > 0, up, down)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - target) * z).sum(), (p - target).sum()])
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        d = np.linalg.solve(hess, grad)
        scale, shift = scale - d[0], shift - d[1]
        if abs(d).max() < 1e-8:
            break
    return {"scale": float(scale), "shift": float(shift)}


def train_on(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 5) -> dict:
    """Model from at most max_rows labelled rows: docs (doc_id, text) joined with labels (doc_id, quality 0 or 1). Null texts and labels are left out; of rows that share a doc_id the smallest text is learned from. The same rows give the same model.

    Executors make the features; they come to the driver a partition at a time and lie in a file there, so no text is on the driver.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = F.broadcast(sampled(usable, ["doc_id"], max_rows, seed))  # at most max_rows rows
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for quality, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, n_words = feature_bytes(text.as_py(), WordIds())
                yield pa.RecordBatch.from_pydict({"quality": pa.array([quality], pa.int32()), "n_words": pa.array([n_words], pa.int64()), "data": pa.array([data], pa.binary())})

    made = rows.orderBy("doc_id").select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(features, "quality int, n_words long, data binary")
    found = Features()
    for row in made.toLocalIterator():
        found.add(bytes(row.data), row.n_words, row.quality)
    model = fit(found, seed)
    give_back()
    return model


def probability(words: list[bytes], h: np.ndarray, model: dict, scores: WordScores) -> float:
    """Calibrated probability that the text is of good quality."""
    z = model["bias"]
    if words:
        total = scores.of(words)
        z += SCALE * total[0] / total[1]
    if len(h) > 1:
        z += SCALE * float(model["pairs"][pair_buckets(h)].sum(dtype=np.float64)) / (len(h) - 1)
    return float(1 / (1 + np.exp(-np.clip(model["scale"] * z + model["shift"], -30, 30))))


def judge(docs: DataFrame, model: dict, text: str = "text", keep_from: float = KEEP_FROM, carried: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score and kept to every row of docs; columns of these names are replaced. carried: the columns to keep (all).

    A null or blank text has no words and fails the base rules. kept is false where base_failed, or
    where the calibrated probability is under keep_from. Whole texts are read, rows one by one.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept"]
    docs = docs.drop(*added)
    carry = [c for c in docs.columns if carried is None or c in carried]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two tables of BUCKETS weights
    at, places = docs.columns.index(text), [docs.columns.index(c) for c in carry]
    names = [*carry, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores, ids = WordScores(model["words"][:, None], SIZES), WordIds()
        for batch in batches:
            told, failed, score = np.zeros((batch.num_rows, 5), np.int64), [], []
            for i, x in enumerate(batch.column(at)):
                words, h, told[i] = counts(x.as_py(), ids)
                failed.append(base_failed(int(told[i, 0]), int(told[i, 4])))
                score.append(probability(words, h, model, scores))
            kept = [not f and s >= keep_from for f, s in zip(failed, score, strict=True)]
            numbers = [pa.array(np.ascontiguousarray(told[:, k])) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), *numbers, pa.array(failed, pa.bool_()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())], names=names)

    told = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"
    return docs.mapInArrow(run, T.StructType([*(docs.schema[k] for k in places), *T._parse_datatype_string(told)]))
