"""Language identification (operator 4): averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of 2 to 4 bytes of each lower-cased word, and the word. They are hashed
to embeddings of 16 numbers; a text is the mean of its subwords' embeddings, and a linear layer with
softmax gives the languages. Both are trained together by stochastic gradient descent in numpy on a
sample of at most ROWS_EACH labelled rows of each language, all of a rarer one; an epoch takes the
pieces of a rarer language more often, up to REPEATS times.

A sampled text is learned from whole: as pieces of PIECES[1] words, which cover all of it, and of its
first PIECES[0] words of each piece, so that short texts are known too. The sample comes to the
driver a partition at a time and is kept in files as word numbers and subwords of words, so the
driver's memory grows by a few bytes with each piece, not with texts or their words. With more than
DIMENSIONS languages the model that goes to the executors is the embeddings and the linear layer,
else a logit for each bucket and language, so its size does not grow with the languages.

Scores are calibrated by temperatures fitted on rows that were held back: one for texts of up to
LENGTHS[0] words (fitted on the short pieces), one for those of up to LENGTHS[1] (on the long ones),
one for longer ones (on whole texts). What falls under ``reject_below`` is rejected.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import BUCKETS, CACHED_WORDS, WordScores, give_back, ngram_buckets, sampled_each, softmax, temperature

SIZES = (2, 3, 4)
ROWS_EACH, DIMENSIONS, EPOCHS, RATE = 500, 16, 2, 0.5
#: Words of a short and of a long piece, and up to how many words a text's score is calibrated like them.
PIECES, LENGTHS = (4, 40), (12, 120)
#: How often an epoch takes an example of a language that has few, at most.
REPEATS = 20
#: Examples of a gradient step, and examples taken at least, by further epochs where the sample is small.
BATCH, MIN_EXAMPLES = 16, 15_000
#: Logits that calibration holds at a time, and words of a stretch whose subwords it sums up.
LOGITS, STRETCH = 1 << 20, 2_000
#: Calibrated probability under which a text is rejected.
REJECT_BELOW = 0.5
UNKNOWN = "und"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def has_letter(text: str) -> bool:
    """Whether a character is of one of the Unicode categories of letters (Lu, Ll, Lt, Lm, Lo)."""
    return any(map(str.isalpha, text))


class Numbers:
    """Whole numbers in a file of the driver that has no name; of what was written, pages that were read lately are in memory."""

    def __init__(self, kind: type):
        self.file, self.kind, self.size = tempfile.TemporaryFile(), np.dtype(kind), 0

    def add(self, values: np.ndarray) -> None:
        self.file.write(values.astype(self.kind).tobytes())
        self.size += len(values)

    def all(self) -> np.ndarray:
        self.file.flush()
        return np.asarray(np.memmap(self.file, self.kind, "r")) if self.size else np.empty(0, self.kind)


class Texts:
    """Texts as word numbers, with the subword buckets of each word, and their pieces (text's label, first word, end)."""

    def __init__(self):
        self._index: dict[bytes, int] = {}  # of words seen lately; a word that comes back later gets one more number
        self._words, self._buckets, self._ends = Numbers(np.int64), Numbers(np.int32), Numbers(np.int64)
        self._whole = array("q")

    def add(self, text: str, label: int) -> None:
        words, first = words_of(text), self._words.size
        for at in range(0, len(words), 50_000):
            self._add(words[at : at + 50_000])
        if words:
            self._whole.extend((label, first, self._words.size))

    def _add(self, words: list[bytes]) -> None:
        index = self._index
        if len(index) + len(words) > CACHED_WORDS:
            index.clear()
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            index.update(zip(new, range(self._ends.size, self._ends.size + len(new)), strict=True))
            buckets, owners = ngram_buckets(new, SIZES)
            before = self._buckets.size
            self._buckets.add(buckets[np.argsort(owners, kind="stable")])
            self._ends.add(before + np.cumsum(np.bincount(owners, minlength=len(new))))
        self._words.add(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))

    def close(self, labels: np.ndarray) -> None:
        """After the last text. labels: what each label is called from now on."""
        self._index.clear()
        self.words, self.buckets, self.ends = self._words.all(), self._buckets.all(), self._ends.all()
        self.whole = np.array(self._whole, np.int64).reshape(-1, 3)
        self.whole[:, 0] = labels[self.whole[:, 0]]

    def pieces(self, size: int) -> np.ndarray:
        """The first size words of each stretch of PIECES[1] words, the last of which may be shorter."""
        label, first, end = self.whole.T
        n = -(-(end - first) // PIECES[1])
        at = np.repeat(first, n) + PIECES[1] * _ranges(np.zeros(len(n), np.int64), n)
        return np.stack([np.repeat(label, n), at, np.minimum(at + size, np.repeat(end, n))], axis=1)

    def subwords(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the subwords of all pieces (label, first, end), and how many each piece has."""
        spans = pieces[:, 2] - pieces[:, 1]
        words = self.words[_ranges(pieces[:, 1], spans)]
        starts = np.where(words > 0, self.ends[np.maximum(words, 1) - 1], 0)
        sizes = self.ends[words] - starts
        return self.buckets[_ranges(starts, sizes)], np.add.reduceat(sizes, np.cumsum(spans) - spans)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


def _logits(table: np.ndarray, weights: np.ndarray | None, texts: Texts, pieces: np.ndarray) -> np.ndarray:
    """Logits of each piece: the mean of table's rows over its subwords, through the linear layer if there is one; a few stretches of at most STRETCH words at a time, so that long texts need little memory."""
    n = -(-(pieces[:, 2] - pieces[:, 1]) // STRETCH)
    owner = np.repeat(np.arange(len(pieces)), n)
    at = pieces[owner, 1] + STRETCH * _ranges(np.zeros(len(n), np.int64), n)
    parts = np.stack([owner, at, np.minimum(at + STRETCH, pieces[owner, 2])], axis=1)
    out, total = np.zeros((len(pieces), table.shape[1])), np.zeros(len(pieces))
    for k in range(0, len(parts), 8):
        buckets, sizes = texts.subwords(parts[k : k + 8])
        np.add.at(out, parts[k : k + 8, 0], np.add.reduceat(table[buckets], np.cumsum(sizes) - sizes, dtype=np.float64))
        np.add.at(total, parts[k : k + 8, 0], sizes)
    out /= total[:, None]
    return out if weights is None else out @ weights


def train(rows: Iterable[tuple[str, str]], seed: int = 11, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE) -> dict:
    """Model from (text, lang) rows, which are read once: languages, table (a row of logits for each bucket, or of numbers that weights, unless None, turn into logits), temperatures. The same rows give the same model."""
    rng = np.random.default_rng(seed)
    seen: dict[str, int] = {}
    fit, check = Texts(), Texts()
    for text, lang in rows:
        held = rng.random() < 0.2 and lang in seen  # a row of each language at least is learned from
        (check if held else fit).add(text, seen.setdefault(lang, len(seen)))
    langs = sorted(seen)
    if not langs:
        return {"langs": [], "table": np.zeros((1, 1), np.float32), "weights": None, "temperatures": (1.0, 1.0, 1.0)}
    labels = np.argsort(np.argsort(np.array(list(seen), object), kind="stable"))
    fit.close(labels)
    check.close(labels)
    embedding = (rng.random((BUCKETS, dimensions), np.float32) - np.float32(0.5)) / np.float32(dimensions)
    weights = np.zeros((dimensions, len(langs)))
    pieces = np.concatenate([fit.pieces(PIECES[0]), fit.pieces(PIECES[1])])
    n = np.bincount(pieces[:, 0], minlength=len(langs))
    taken = np.repeat(np.arange(len(pieces)), np.clip(n.max() // np.maximum(n, 1), 1, REPEATS)[pieces[:, 0]])
    epochs = max(epochs, -(-MIN_EXAMPLES // max(1, len(taken)))) if len(taken) else 0
    columns = np.arange(dimensions)
    done, total = 0, max(1, epochs * len(taken))
    for _ in range(epochs):
        order = rng.permutation(taken)
        for k in range(0, len(order), BATCH):
            batch = pieces[order[k : k + BATCH]]
            lr = rate * (1 - done / total)
            done += len(batch)
            buckets, sizes = fit.subwords(batch)
            mean = np.add.reduceat(embedding[buckets], np.cumsum(sizes) - sizes) / sizes[:, None]
            error = softmax(mean @ weights)
            error[np.arange(len(batch)), batch[:, 0]] -= 1
            back = (lr / sizes[:, None]) * (error @ weights.T)
            weights -= lr * (mean.T @ error)
            np.subtract.at(embedding.reshape(-1), (buckets[:, None].astype(np.int64) * dimensions + columns).ravel(), np.repeat(back.astype(np.float32), sizes, axis=0).ravel())
    table, layer = ((embedding @ weights).astype(np.float32), None) if len(langs) <= dimensions else (embedding, weights)
    kinds = [check.pieces(PIECES[0]), check.pieces(PIECES[1]), check.whole]
    step = max(8, LOGITS // len(langs) // 8 * 8)
    blocks = lambda x: ((_logits(table, layer, check, x[k : k + step]), x[k : k + step, 0]) for k in range(0, len(x), step))
    return {"langs": langs, "table": table, "weights": layer, "temperatures": tuple(temperature(blocks(x), len(x)) for x in kinds)}


def train_on(labelled: DataFrame, rows_each: int = ROWS_EACH, seed: int = 11) -> dict:
    """Model from a sample of at most rows_each rows of each lang of labelled (doc_id, text, lang); rows with null text or lang are left out."""
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    rows = sampled_each(usable, "lang", ["doc_id", "text"], rows_each, seed).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "lang")
    model = train(((r.text, r.lang) for r in rows.toLocalIterator()), seed)  # a partition is on the driver at a time
    give_back()
    return model


def predict(text: str | None, model: dict, scores: WordScores) -> tuple[str, float]:
    """(lang, calibrated probability); UNKNOWN and 0 for a text that is null, has no letter, or if nothing was learned."""
    if not text or not model["langs"] or not has_letter(text):
        return UNKNOWN, 0.0
    words = words_of(text)
    total = scores.of(words)
    logits = total[:-1] / max(total[-1], 1)
    if model.get("weights") is not None:
        logits = logits @ model["weights"]
    p = softmax(logits / model["temperatures"][sum(len(words) > n for n in LENGTHS)])
    best = int(p.argmax())
    return model["langs"][best], float(min(1.0, p[best]))


def identify(docs: DataFrame, model: dict, text: str = "text", reject_below: float = REJECT_BELOW, carried: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, lang_score and lang_rejected to every row of docs; columns of these names are replaced. carried: the columns to keep (all).

    lang_pred is ``und``, with score 0 and rejected, where the text is null or has no letter; whole
    texts are read, repeated rows are judged alike.
    """
    added = ["lang_pred", "lang_score", "lang_rejected"]
    docs = docs.drop(*added)
    kept = [c for c in docs.columns if carried is None or c in carried]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS rows of at most DIMENSIONS numbers
    at, places = docs.columns.index(text), [docs.columns.index(c) for c in kept]
    names = [*kept, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = WordScores(model["table"], SIZES)
        for batch in batches:
            found = [predict(x.as_py(), model, scores) for x in batch.column(at)]
            score = pa.array([x[1] for x in found], pa.float64())
            rejected = pa.array([x[0] == UNKNOWN or x[1] < reject_below for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), pa.array([x[0] for x in found], pa.string()), score, rejected], names=names)

    schema = T.StructType([*(docs.schema[k] for k in places), *T._parse_datatype_string("lang_pred string, lang_score double, lang_rejected boolean")])
    return docs.mapInArrow(run, schema)
