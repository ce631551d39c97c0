"""Packing along a space-filling curve (operator 6).

Token ids are hashed to a signed vector, which is projected to four dimensions; each is cut into 256
levels, and the Hilbert index of the cell orders the documents, so that neighbours on the curve are
alike. Documents are laid end to end in that order (below the curve, by a hash of doc_id, so that a
large group of copies is spread over partitions) and the stream is cut at every ``length`` tokens:
only the last sequence is padded.

The tokens are computed once, written to the shared folder with their key, and cut into buckets by
quantiles of the key, as many as keep a bucket small; the start of each comes from the totals of the
buckets before it (one row each).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cuts_of, materialize, part_of, prefix_sums

LENGTH, END_ID = 1024, 0
#: Rows in an Arrow batch of whole texts, and of documents that are cut at a time.
BATCH_ROWS, CUT_ROWS = 2_000, 1_000
#: Tokens of a bucket of the curve, about, where the session has fewer partitions.
BUCKET_TOKENS = 1 << 23
DIMENSIONS, LEVEL_BITS, HASHED = 4, 8, 512
_rng = np.random.default_rng(23)
_PROJECTION = _rng.standard_normal((HASHED, DIMENSIONS))
_CELL, _SIGN = _rng.integers(0, HASHED, 1 << 16), _rng.choice([-1.0, 1.0], 1 << 16)


def _byte_of() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file as ranks, without added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = _byte_of()
    special = {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}


def added_of(path: str) -> dict[str, int]:
    """The added tokens of the file; they are found in a text before its words are."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if odd := [x["content"] for x in added if x.get("single_word") or x.get("lstrip") or x.get("rstrip")]:
        raise ValueError(f"added tokens that match by what stands beside them are not known: {odd}")
    return {x["content"]: x["id"] for x in added}


def encoder(ranks: dict[bytes, int], added: dict[str, int] | None = None, spec: str | None = None):
    """text -> array of ids; the strings of added tokens get their own ids, without added they are plain text.

    Ranks give the ids of the file's merges several times faster. Their pattern gives up on runs of
    about a million white-space characters; such a text is encoded by the file itself (spec: what it holds).
    """
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    whole: list = []

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:
            if spec is None:
                raise
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_str(spec))
            whole[0].encode_special_tokens = not added
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def spec_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, d) with coordinates under 2**bits."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def point(ids: np.ndarray) -> np.ndarray:
    """A document's ids as a hashed signed vector of length 1, projected to DIMENSIONS."""
    if not len(ids):
        return np.zeros(DIMENSIONS)
    at = ids.astype(np.int64) & 0xFFFF
    vector = np.bincount(_CELL[at], weights=_SIGN[at], minlength=HASHED)
    return vector @ _PROJECTION / max(np.sqrt(vector @ vector), 1e-9)


def curve_keys(points: np.ndarray) -> np.ndarray:
    """Hilbert keys (DIMENSIONS * LEVEL_BITS bits) of projected vectors (n, DIMENSIONS), whose numbers are near standard normal."""
    levels = 1 / (1 + np.exp(-1.702 * points))
    return hilbert_index(np.minimum((levels * (1 << LEVEL_BITS)).astype(np.int64), (1 << LEVEL_BITS) - 1), LEVEL_BITS)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, key, n_tokens, ids (little-endian unsigned 16 bits if the vocabulary allows, else 32) for every row of docs."""

    shared = docs.sparkSession.sparkContext.broadcast((ranks_of(tokenizer), added_of(tokenizer), spec_of(tokenizer)))  # the size of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*shared.value)
        for batch in batches:
            points, lengths, blobs = np.zeros((batch.num_rows, DIMENSIONS)), [], []
            doc_ids = batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                ids = encode(text.as_py() or "")
                points[i] = point(ids)
                lengths.append(len(ids) + 1)
                wide = max(end_id, int(ids.max()) if len(ids) else 0) > 65535
                kind = "<u4" if wide else "<u2"
                blobs.append(b"".join((b"4" if wide else b"2", ids.astype(kind).tobytes(), np.array(end_id, kind).tobytes())))
            spread = np.array([crc32(b"%d" % (x or 0)) >> 1 for x in doc_ids], np.int64)
            keys = curve_keys(points) << 31 | spread
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())], names=["row", "doc_id", "key", "n_tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, key long, n_tokens long, ids binary")


def lay_out(tokens: DataFrame) -> DataFrame:
    """Adds first: the place of each row's first token in the stream, in the order (key, doc_id, row)."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    cuts = cuts_of(tokens, "key", max(4 * parts, -(-total // BUCKET_TOKENS)))
    placed = prefix_sums(tokens.withColumn("_bucket", part_of(F.col("key"), cuts)), [], "_bucket", ["key", "doc_id", "row"], "n_tokens", "_upto")
    return placed.withColumn("first", F.col("_upto") - F.col("n_tokens")).drop("_upto", "_bucket")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array) of the piece.

    docs: doc_id, text (other columns are not read). A null or empty text is its end id alone.
    Repeated rows are packed each. The same rows give the same sequences.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        tokens = materialize(tokenize(docs, tokenizer, end_id), "tokens")
    laid = lay_out(tokens)
    width = length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, CUT_ROWS) for b in batches for k in range(0, b.num_rows, CUT_ROWS)):
            out: list[list] = [[] for _ in range(8)]
            for doc_id, first, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = blob.as_py()
                ids = np.frombuffer(blob, "<u2" if blob[:1] == b"2" else "<u4", offset=1).astype("<u4")
                start, total = 0, len(ids)
                while start < total:
                    place = first + start
                    take = min(width - place % width, total - start)
                    piece = ids[start : start + take]
                    for column, value in zip(out, (doc_id, start, take, crc32(piece.tobytes()), total, place // width, place % width, piece), strict=True):
                        column.append(value)
                    start += take
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *out[2]]).astype(np.int32)), pa.array(np.concatenate([*out[7], np.empty(0, "<u4")]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:7]), lists], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return laid.select("doc_id", "first", "ids").mapInArrow(run, schema)
