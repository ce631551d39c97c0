"""Alignment of two tokenizers (operator 11).

Every text is tokenized twice: by a byte-level BPE file (A, of space and text) and by a sentencepiece
model (B, which adds the space itself). Both token sequences spell the same bytes, so the cumulative
ends of their tokens are merged like two sorted lists, inside mapInPandas: ends that both have cut the
text into groups, and every stretch between neighbouring ends lies in exactly one token of each side,
which is a link. A text that one side does not spell byte for byte has no tokens.

Documents are merged in chunks of about CHUNK_TOKENS tokens. A chunk is one row: its distinct id pairs
with the number of its documents that hold them, and which pairs each document holds how often.
Spark sums up the documents of each pair (groupBy), takes the largest of each id on either side, and
joins all three back to the pairs of the chunks, so a pair, however common, is one entry for each
chunk. Nothing is collected; only the maxima are broadcast, at most a row for each id of a vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize
from .lm_score import packed, unpacked
from .packing import encoder, ranks_of, spec_of

#: Tokens of both sides in a chunk (whole documents, so a longer one makes a longer chunk).
CHUNK_TOKENS = 1 << 21
#: Rows in an Arrow batch of whole texts; characters that are merged at a time (a longer text alone).
BATCH_ROWS, MERGE_CHARS = 500, 1 << 20
_A_WIDTH = 1 << 24  # ids of B lie below it


class Tokenizers:
    """Both tokenizers in a worker: ids of texts, and the bytes of each id."""

    def __init__(self, spec_a: str, ranks: dict[bytes, int], model_b: bytes):
        import sentencepiece

        self.encode_a = encoder(ranks, None, spec_a)
        size = 1 + max(ranks.values())
        self.length_a = np.zeros(size, np.int64)
        self.length_a[list(ranks.values())] = [len(x) for x in ranks]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        pieces = range(self.model.get_piece_size())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k in pieces for p in [self.model.id_to_piece(k)]]
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        names = [str(k) for k in range(max(size, len(self.bytes_b)))]
        #: id and what follows it: "," inside a side, "|" after A's last of a group, ";" after B's
        self.names = np.array([n + c for n in names for c in ",|;"], object)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None if one does not spell the space and the text."""
        whole = " " + text
        spelled = whole.encode("utf-8", "surrogatepass")
        b = self.model.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != spelled:
            return None
        a = self.encode_a(whole).astype(np.int64)
        return (a, np.array(b, np.int64)) if self.length_a[a].sum() == len(spelled) else None


@dataclass
class Merged:
    """Merged token sequences of some texts. Links are those that end with a token of A, in order, then those that end within one."""

    a: np.ndarray  # ids of A, all texts
    b: np.ndarray
    n_a: np.ndarray  # tokens of each text
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    group_a: np.ndarray  # the group of each token, counted over all texts
    group_b: np.ndarray
    link_a: np.ndarray  # the tokens of each link
    link_b: np.ndarray
    link_doc: np.ndarray
    begin: np.ndarray  # the bytes of each link, counted over all texts
    end: np.ndarray


def merge(found: list[tuple[np.ndarray, np.ndarray] | None], length_a: np.ndarray, length_b: np.ndarray) -> Merged:
    """Merges the cumulative ends of both sides. The texts lie end to end: both sides end together at each text's end, so no group or link crosses it."""
    none = np.empty(0, np.int64)
    a, b = (np.concatenate([none, *(x[side] for x in found if x is not None)]) for side in (0, 1))
    n_a, n_b = (np.array([0 if x is None else len(x[side]) for x in found], np.int64) for side in (0, 1))
    ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    at_b = np.searchsorted(ends_b, ends_a)  # the token of B in which each token of A ends
    at_a = np.searchsorted(ends_a, ends_b)
    both_a = ends_b[at_b] == ends_a if len(b) else np.zeros(0, bool)
    both_b = ends_a[at_a] == ends_b if len(a) else np.zeros(0, bool)
    doc_a, doc_b = np.repeat(np.arange(len(found)), n_a), np.repeat(np.arange(len(found)), n_b)
    inside = np.flatnonzero(~both_b)
    n_groups = np.bincount(doc_a[both_a], minlength=len(found))
    begin_a = np.maximum(ends_a - length_a[a], np.concatenate([[0], ends_b])[at_b]) if len(a) else none
    begin_b = np.maximum(ends_b - length_b[b], np.concatenate([[0], ends_a])[at_a]) if len(b) else none
    return Merged(
        a, b, n_a, n_b, n_groups, n_a + n_b - n_groups, np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b,
        np.concatenate([np.arange(len(a)), at_a[inside]]), np.concatenate([at_b, inside]), np.concatenate([doc_a, doc_b[inside]]),
        np.concatenate([begin_a, begin_b[inside]]), np.concatenate([ends_a, ends_b[inside]]),
    )


def group_texts(m: Merged, names: np.ndarray) -> list[str]:
    """The groups of each text, as a1,a2|b1;a3|b2,b3 (decimal ids)."""
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (m.group_a, m.group_b))
    # in the order of the text: A's tokens of a group, then B's
    place_a = np.arange(len(m.a)) + np.searchsorted(m.group_b, m.group_a, "left")
    place_b = np.arange(len(m.b)) + np.searchsorted(m.group_a, m.group_b, "right")
    told = np.empty(len(m.a) + len(m.b), np.int64)
    told[place_a], told[place_b] = m.a * 3 + last_a, m.b * 3 + 2 * last_b
    words, ends = names[told].tolist(), np.cumsum(m.n_a + m.n_b).tolist()
    return ["".join(words[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]


def _sources(docs: DataFrame, file_a: str, file_b: str):
    with open(file_b, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((spec_of(file_a), ranks_of(file_a), f.read()))  # the size of the vocabularies
    # ids as strings: pandas would make doubles of longs with nulls
    return shared, docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _longs(doc_ids) -> pd.array:
    return pd.array([None if x is None else int(x) for x in doc_ids], "Int64")


def _parts(batches: Iterator[pd.DataFrame], tokenizers: Tokenizers) -> Iterator[tuple[list, Merged]]:
    """doc_ids and merged tokens of some rows at a time."""
    for batch in batches:
        doc_ids, found, size = [], [], 0
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            doc_ids.append(doc_id)
            found.append(tokenizers.ids(text) if text else None)
            size += len(text or "")
            if size >= MERGE_CHARS:
                yield doc_ids, merge(found, tokenizers.length_a, tokenizers.length_b)
                doc_ids, found, size = [], [], 0
        if doc_ids:
            yield doc_ids, merge(found, tokenizers.length_a, tokenizers.length_b)


_GROUPS = "doc_id long, group int, a array<int>, b array<int>, first_byte long, end_byte long"
_LINKS = "doc_id long, a_at int, b_at int, a_id int, b_id int, first_byte long, end_byte long"


def groups(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """The groups of every row of docs (doc_id, text): their number in the text, the ids of both sides, and their bytes in space and text."""
    shared, rows = _sources(docs, file_a, file_b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tokenizers(*shared.value)
        for doc_ids, m in _parts(batches, t):
            cut = [np.flatnonzero(np.append(g[1:] != g[:-1], True)[: len(g)]) + 1 for g in (m.group_a, m.group_b)]
            a, b = np.split(m.a, cut[0])[:-1], np.split(m.b, cut[1])[:-1]
            ends, doc = np.cumsum([t.length_a[x].sum() for x in a]).astype(np.int64), np.repeat(np.arange(len(doc_ids)), m.n_groups)
            before = np.cumsum(m.n_groups) - m.n_groups
            base = np.concatenate([[0], ends])[before]
            begin = np.concatenate([[0], ends])[:-1]
            yield pd.DataFrame({"doc_id": _longs(doc_ids[k] for k in doc), "group": np.arange(len(a)) - before[doc], "a": a, "b": b, "first_byte": begin - base[doc], "end_byte": ends - base[doc]})

    return rows.mapInPandas(run, _GROUPS)


def links(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """The links of every row of docs (doc_id, text): places and ids of both tokens, and the bytes that they share, in space and text."""
    shared, rows = _sources(docs, file_a, file_b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tokenizers(*shared.value)
        for doc_ids, m in _parts(batches, t):
            first_a, first_b = (np.cumsum(n) - n for n in (m.n_a, m.n_b))
            base = np.concatenate([[0], np.cumsum(t.length_a[m.a])])[first_a]
            doc = m.link_doc
            yield pd.DataFrame({
                "doc_id": _longs(doc_ids[k] for k in doc), "a_at": m.link_a - first_a[doc], "b_at": m.link_b - first_b[doc],
                "a_id": m.a[m.link_a], "b_id": m.b[m.link_b], "first_byte": m.begin - base[doc], "end_byte": m.end - base[doc],
            })

    return rows.mapInPandas(run, _LINKS)


_CHUNK = "chunk long, doc_ids array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, pairs array<long>, n_docs array<int>, sizes array<int>, held binary, times binary"


def _chunks(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """One row for each chunk. pairs: distinct id pairs, with n_docs; sizes: how many of them each document holds; held: the differences of their numbers, document after document; times: how often."""
    shared, rows = _sources(docs, file_a, file_b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, held, size, made = Tokenizers(*shared.value), [], 0, 0

        def out() -> pd.DataFrame:
            merged = [m for _, m, _ in held]
            number, pairs = pd.factorize(np.concatenate([m.a[m.link_a] * _A_WIDTH + m.b[m.link_b] for m in merged]))
            first = np.cumsum([0, *(len(m.n_a) for m in merged)])
            doc = np.concatenate([m.link_doc + k for m, k in zip(merged, first, strict=False)])
            width = max(1, len(pairs))
            code, times = np.unique(doc * width + number, return_counts=True)
            return pd.DataFrame([{
                "chunk": TaskContext.get().partitionId() << 32 | made, "doc_ids": [x for ids, _, _ in held for x in ids],
                **{c: np.concatenate([getattr(m, c) for m in merged]) for c in ("n_a", "n_b", "n_groups")}, "groups_sha256": [x for _, _, told in held for x in told],
                "pairs": pairs, "n_docs": np.bincount(code % width, minlength=len(pairs)).astype(np.int32), "sizes": np.bincount(code // width, minlength=first[-1]).astype(np.int32),
                "held": packed(np.diff(code % width, prepend=0).astype("<i4")), "times": packed(times.astype("<u4")),
            }])

        for doc_ids, m in _parts(batches, t):
            told = [hashlib.sha256(x.encode()).hexdigest() if n else "" for x, n in zip(group_texts(m, t.names), m.n_a.tolist(), strict=True)]
            held.append((doc_ids, m, told))
            size += len(m.a) + len(m.b) + len(doc_ids)
            if size >= CHUNK_TOKENS:
                yield out()
                held, size, made = [], 0, made + 1
        if held:
            yield out()

    return rows.mapInPandas(run, _CHUNK)


def _counted(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of the chunks (chunk, at, pair), and of the corpus (pair, n, best_a, best_b): documents that hold the pair, and the most of a pair with the same id on one side."""
    held = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("at", "x")).select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.n_docs").alias("n_docs"))
    n = held.groupBy("pair").agg(F.sum("n_docs").alias("n"))
    n = materialize(n.select("pair", "n", F.expr(f"pair div {_A_WIDTH}").alias("a"), (F.col("pair") % _A_WIDTH).alias("b")), "pair-counts")
    # a row for each id of a vocabulary at most
    best = [F.broadcast(n.groupBy(side).agg(F.max("n").alias(f"best_{side}"))) for side in "ab"]
    return held.drop("n_docs"), n.join(best[0], "a").join(best[1], "b")


def pair_counts(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """a_id, b_id, n_docs (documents that hold them linked), best_a, best_b (the most of a pair with this a_id, with this b_id): a dictionary from one vocabulary to the other."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        chunks = materialize(_chunks(docs, file_a, file_b), "token-chunks")
    counts = _counted(chunks)[1]
    return counts.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.col("n").alias("n_docs"), "best_a", "best_b")


def align(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """One row for every row of docs (doc_id, text; other columns are not read).

    doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, n_best_b (links whose count is the highest of
    their A id, of their B id, ties included), count_sum (of the counts of all links), groups_sha256.
    A link's count is the number of rows of docs that hold its id pair linked. A text that is null or
    empty, or that one side does not spell byte for byte (as white space or characters were changed),
    has no tokens: zeros and an empty digest. Repeated rows count each.
    """
    rows = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}  # a chunk is a large row
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        chunks = materialize(_chunks(docs, file_a, file_b), "token-chunks", **rows)
    held, counts = _counted(chunks)
    answers = held.join(counts, "pair").select(F.col("chunk").alias("of"), "at", "n", (F.col("n") == F.col("best_a")).alias("is_a"), (F.col("n") == F.col("best_b")).alias("is_b"))

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row, sizes = rows.iloc[0], np.asarray(rows.iloc[0]["sizes"], np.int64)
        n, is_a, is_b = (np.zeros(len(answers), np.int64) for _ in range(3))
        at = answers["at"].to_numpy()
        n[at], is_a[at], is_b[at] = answers["n"], answers["is_a"], answers["is_b"]
        held, times = np.cumsum(unpacked(row["held"], "<i4").astype(np.int64)), unpacked(row["times"], "<u4").astype(np.int64)
        ends = np.cumsum(sizes)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[held] * times)])[np.concatenate([[0], ends])])
        n_a, n_b, n_groups = (np.asarray(row[c], np.int64) for c in ("n_a", "n_b", "n_groups"))
        return pd.DataFrame({"doc_id": _longs(row["doc_ids"]), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, "n_best": total(is_a), "n_best_b": total(is_b), "count_sum": total(n), "groups_sha256": row["groups_sha256"]})

    parts = chunks.drop("pairs", "n_docs").groupBy("chunk").cogroup(answers.groupBy("of"))
    return parts.applyInPandas(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string")
