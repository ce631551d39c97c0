"""Dynamic-programming kernels in numpy, and their Arrow wrappers. They run on candidates that survived seeding only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.cigar import EDIT, left_align
from ..functions.config import Scoring

_LOW = -(1 << 28)


def penalties(qual: str | None, n: int, s: Scoring) -> np.ndarray:
    """Mismatch penalty of each read base."""
    if s.ignore_quals or not qual:
        return np.full(n, s.mismatch_max, np.int64)
    q = np.clip(np.frombuffer(qual.encode(), np.uint8).astype(np.int64) - 33, 0, 40)
    return s.mismatch_min + (q / 40.0 * (s.mismatch_max - s.mismatch_min)).astype(np.int64)


def substitution(read: str, ref: str, qual: str | None, s: Scoring) -> np.ndarray:
    """Score of every read base against every reference base."""
    a, b = np.frombuffer(read.encode(), np.uint8), np.frombuffer(ref.encode(), np.uint8)
    out = np.where(a[:, None] == b[None, :], s.match, -penalties(qual, len(a), s)[:, None])
    unknown = ~np.isin(a, list(b"ACGT"))[:, None] | ~np.isin(b, list(b"ACGT"))[None, :]
    return np.where(unknown, -s.n_penalty, out)


def affine(read: str, ref: str, qual: str | None = None, s: Scoring = Scoring(), local: bool = False, fixed_ends: bool = False) -> tuple[int, int, int, list]:
    """Best alignment of the whole read (local: of any part) to a stretch of ref with affine gaps: (score, start in ref, clipped read bases at the left, edits)."""
    score, start, left, _, edits = affine_ends(read, ref, qual, s, local, fixed_ends)
    return score, start, left, edits


def affine_ends(read: str, ref: str, qual: str | None = None, s: Scoring = Scoring(), local: bool = False, fixed_ends: bool = False) -> tuple[int, int, int, int, list]:
    """affine() with the clipped read bases at the right before the edits.

    End gaps of the reference are free unless fixed_ends. Rows are read bases; a row is filled at
    once, the gaps along the reference by a running maximum.
    """
    n, m = len(read), len(ref)
    sub = substitution(read, ref, qual, s)
    bonus = 2 if local and not s.match else 0
    if bonus:
        sub = np.where(sub == s.match, bonus, sub)
    h = np.full((n + 1, m + 1), _LOW, np.int64)
    ins, gone = np.full((n + 1, m + 1), _LOW, np.int64), np.full((n + 1, m + 1), _LOW, np.int64)
    h[0] = 0 if not fixed_ends else [0] + [-(s.read_gap_open + k * s.read_gap_extend) for k in range(1, m + 1)]
    if local:
        h[:, 0] = 0
    cols = np.arange(m + 1)
    for i in range(1, n + 1):
        ins[i] = np.maximum(ins[i - 1], h[i - 1] - s.ref_gap_open) - s.ref_gap_extend
        row = np.maximum(ins[i], h[i])
        row[1:] = np.maximum(row[1:], h[i - 1, :-1] + sub[i - 1])
        if local:
            row = np.maximum(row, 0)
        best = np.maximum.accumulate(row + s.read_gap_extend * cols)
        gone[i, 1:] = best[:-1] - s.read_gap_open - s.read_gap_extend * cols[1:]
        h[i] = np.maximum(row, gone[i])
    if local:
        i, j = (int(x) for x in np.unravel_index(int(h.argmax()), h.shape))
    else:
        i, j = n, m if fixed_ends else int(h[n].argmax())
    score = int(h[i, j])
    if not local:
        j, edits = _trace(h, ins, gone, sub, read, ref, i, j, s, fixed_ends)
        return score, j, 0, 0, left_align(read, edits)
    # of a local alignment the part up to the first place where nothing is gained
    end = i
    i, j, edits = _trace_local(h, ins, gone, sub, read, ref, i, j, s)
    return score, j, i, n - end, left_align(read[i:end], [e | {"pos": e["pos"] - i} for e in edits])


def affine_batch(reads: list[str], refs: list[str], quals: list, s: Scoring = Scoring(), fixed_ends: bool = False) -> list[tuple[int, int, int, list]]:
    """affine() of candidates whose reads have one length and whose windows have one length.

    A read that fits its window without any loss at some place is done at once. For the others the
    rows of all tables are filled together; where the best score is that of a single diagonal, which
    is the common case, the edits are its mismatches, and only the rest is traced back step by step.
    """
    n, m = len(reads[0]), len(refs[0])
    a, b = (np.array([np.frombuffer(x.encode(), np.uint8) for x in xs]) for xs in (reads, refs))
    pen = np.array([penalties(q, n, s) for q in quals])
    known, ref_known = (np.isin(x, list(b"ACGT")) for x in (a, b))
    sub = lambda rows, i, lo, hi: np.where(known[rows, i, None] & ref_known[rows, lo:hi], np.where(a[rows, i, None] == b[rows, lo:hi], s.match, -pen[rows, i, None]), -s.n_penalty)
    out: list = [None] * len(reads)
    rest = np.arange(len(reads))
    if m >= n and not fixed_ends:
        spans = np.lib.stride_tricks.sliding_window_view(b, n, axis=1)
        whole = (spans == a[:, None, :]).all(axis=2) & known.all(axis=1)[:, None]
        for k in np.flatnonzero(whole.any(axis=1)):
            out[k] = (n * s.match, int(whole[k].argmax()), 0, [])
        rest = np.flatnonzero(~whole.any(axis=1))
    if not len(rest):
        return out
    h = np.full((n + 1, len(rest), m + 1), _LOW, np.int32)
    ins, gone = h.copy(), h.copy()
    h[0] = np.concatenate([[0], -(s.read_gap_open + s.read_gap_extend * np.arange(1, m + 1))]) if fixed_ends else 0
    cols = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        ins[i] = np.maximum(ins[i - 1], h[i - 1] - s.ref_gap_open) - s.ref_gap_extend
        row = np.maximum(ins[i], h[i])
        row[:, 1:] = np.maximum(row[:, 1:], h[i - 1, :, :-1] + sub(rest, i - 1, 0, m))
        best = np.maximum.accumulate(row + s.read_gap_extend * cols, axis=1)
        gone[i, :, 1:] = best[:, :-1] - s.read_gap_open - s.read_gap_extend * cols[1:]
        h[i] = np.maximum(row, gone[i])
    ends = np.full(len(rest), m) if fixed_ends else h[n].argmax(axis=1)
    for k, (row, j) in enumerate(zip(rest.tolist(), ends.tolist(), strict=True)):
        score = int(h[n, k, j])
        start = j - n
        if start >= 0 and not (fixed_ends and start):
            piece = b[row, start:j]
            cost = np.where(known[row] & ref_known[row, start:j], np.where(a[row] == piece, s.match, -pen[row]), -s.n_penalty)
            if int(cost.sum()) == score:
                ref, read = refs[row], reads[row]
                out[row] = (score, start, 0, [{"pos": int(x), "type": "mm", "ref": ref[start + x], "read": read[x], "length": 1, "snp": None} for x in np.flatnonzero(a[row] != piece)])
                continue
        cost = np.where(known[row][:, None] & ref_known[row][None, :], np.where(a[row][:, None] == b[row][None, :], s.match, -pen[row][:, None]), -s.n_penalty)
        j, edits = _trace(h[:, k], ins[:, k], gone[:, k], cost, reads[row], refs[row], n, j, s, fixed_ends)
        out[row] = (score, j, 0, left_align(reads[row], edits))
    return out


def _trace(h: np.ndarray, ins: np.ndarray, gone: np.ndarray, sub: np.ndarray, read: str, ref: str, i: int, j: int, s: Scoring, fixed_ends: bool) -> tuple[int, list]:
    """Start in ref, and edits from left to right, of the best path that ends at (i, j)."""
    return _path(h, ins, gone, sub, read, ref, i, j, s, fixed_ends, False)[1:]


def _trace_local(h: np.ndarray, ins: np.ndarray, gone: np.ndarray, sub: np.ndarray, read: str, ref: str, i: int, j: int, s: Scoring) -> tuple[int, int, list]:
    """Start in the read, start in ref and edits of the best path that ends at (i, j) and begins where nothing is gained before it."""
    return _path(h, ins, gone, sub, read, ref, i, j, s, False, True)


def _path(h: np.ndarray, ins: np.ndarray, gone: np.ndarray, sub: np.ndarray, read: str, ref: str, i: int, j: int, s: Scoring, fixed_ends: bool, local: bool) -> tuple[int, int, list]:
    edits, state, run = [], "h", 0
    edit = lambda pos, kind, gone_, put, size: edits.append({"pos": pos, "type": kind, "ref": gone_, "read": put, "length": size, "snp": None})
    while (i > 0 or (fixed_ends and j > 0)) and not (local and state == "h" and h[i, j] == 0):
        if state == "h":
            if i and j and h[i, j] == h[i - 1, j - 1] + sub[i - 1, j - 1]:
                if read[i - 1] != ref[j - 1]:
                    edit(i - 1, "mm", ref[j - 1], read[i - 1], 1)
                i, j = i - 1, j - 1
            elif i and h[i, j] == ins[i, j]:
                state, run = "ins", 0
            elif j and h[i, j] == gone[i, j]:
                state, run = "del", 0
            elif i == 0:
                edit(0, "del", ref[:j], "", j)
                j = 0
            else:
                break
        elif state == "ins":
            run, opened = run + 1, ins[i, j] == h[i - 1, j] - s.ref_gap_open - s.ref_gap_extend
            i -= 1
            if opened:
                edit(i, "ins", "", read[i : i + run], run)
                state = "h"
        else:
            run, opened = run + 1, gone[i, j] == h[i, j - 1] - s.read_gap_open - s.read_gap_extend
            j -= 1
            if opened:
                edit(i, "del", ref[j : j + run], "", run)
                state = "h"
    edits.reverse()
    return i, j, edits


#: Candidates whose tables are filled at once.
BATCH = 128


def affine_all(reads: list[str], refs: list[str], quals: list, s: Scoring = Scoring(), local: bool = False, fixed_ends: bool = False) -> list[tuple[int, int, int, list]]:
    """affine() of each candidate, those of equal lengths together; (very low, 0, 0, []) where a read or its window is empty."""
    out: list = [(_LOW, 0, 0, [])] * len(reads)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (r, w) in enumerate(zip(reads, refs, strict=True)):
        if r and w:
            groups.setdefault((len(r), len(w)), []).append(k)
    for rows in groups.values():
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            told = [affine(reads[k], refs[k], quals[k], s, True, fixed_ends) for k in part] if local else affine_batch([reads[k] for k in part], [refs[k] for k in part], [quals[k] for k in part], s, fixed_ends)
            for k, x in zip(part, told, strict=True):
                out[k] = x
    return out


def ungapped(read: str, ref: str, qual: str | None = None, s: Scoring = Scoring()) -> tuple[int, list]:
    """Score and mismatches on one diagonal; ref has the read's length."""
    a, b = np.frombuffer(read.encode(), np.uint8), np.frombuffer(ref.encode(), np.uint8)
    known = np.isin(a, list(b"ACGT")) & np.isin(b, list(b"ACGT"))
    score = np.where(~known, -s.n_penalty, np.where(a == b, s.match, -penalties(qual, len(a), s)))
    edits = [{"pos": int(k), "type": "mm", "ref": ref[k], "read": read[k], "length": 1, "snp": None} for k in np.flatnonzero(a != b)]
    return int(score.sum()), edits


def extend(read: str, ref: str, at: int, ref_at: int, length: int, mismatches: int) -> tuple[int, int]:
    """How far an exact hit (read[at:at+length] at ref_at) goes left and right with so many mismatches on each side."""
    left = right = 0
    budget = mismatches
    while at - left > 0 and ref_at - left > 0:
        if read[at - left - 1] != ref[ref_at - left - 1]:
            if not budget:
                break
            budget -= 1
        left += 1
    budget = mismatches
    while at + length + right < len(read) and ref_at + length + right < len(ref):
        if read[at + length + right] != ref[ref_at + length + right]:
            if not budget:
                break
            budget -= 1
        right += 1
    return left, right


#: First and last two bases of an intron, and which sites are canonical.
MOTIFS = {("GT", "AG"): ("+", True), ("CT", "AC"): ("-", True), ("GC", "AG"): ("+", False), ("CT", "GC"): ("-", False), ("AT", "AC"): ("+", False), ("GT", "AT"): ("-", False)}


def combine(read: str, left_ref: str, right_ref: str, gap: int, s: Scoring = Scoring(), qual: str | None = None) -> dict | None:
    """Joins two partial hits of a read: left_ref are the reference bases from the first hit's start on, right_ref those that end where the second hit ends, both as long as the read at least; gap is how many more bases the reference has between the two than the read.

    gap 0: one diagonal. gap < 0: an insertion. 0 < gap < least intron: a deletion. Else: an intron, placed
    where the score is best, canonical sites first. None if the read cannot be joined that way.
    """
    n = len(read)
    if gap < 0:
        right_ref = right_ref[-(n + gap) :] if n + gap > 0 else ""
    if n + min(gap, 0) <= 0 or len(left_ref) < n + min(gap, 0) or len(right_ref) < n + min(gap, 0):
        return None
    pen = penalties(qual, n, s)
    a = np.frombuffer(read.encode(), np.uint8)
    lost = -gap if gap < 0 else 0
    room = n - lost
    left = np.frombuffer(left_ref[:room].encode(), np.uint8)
    right = np.frombuffer(right_ref[-room:].encode(), np.uint8)
    cost_left = np.concatenate([[0], np.cumsum(np.where(a[:room] == left, 0, pen[:room]))])
    tail = np.where(a[lost:] == right, 0, pen[lost:])
    cost_right = np.concatenate([np.cumsum(tail[::-1])[::-1], [0]])
    total = cost_left + cost_right
    kind, strand, canonical = ("none" if not gap else "ins" if gap < 0 else "del"), None, False
    if gap >= s.min_intron:
        kind = "spl"
        extra = np.full(room + 1, s.noncanonical, np.int64)
        ranks = {}
        for k in range(1, room):
            donor, acceptor = left_ref[k : k + 2], right_ref[len(right_ref) - room + k - 2 : len(right_ref) - room + k] if len(right_ref) - room + k >= 2 else ""
            found = MOTIFS.get((donor, acceptor))
            if found:
                ranks[k] = found
                extra[k] = s.canonical if found[1] else s.noncanonical
        total = total + extra
        k = min(range(1, room), key=lambda k: (total[k], not ranks.get(k, ("", False))[1], k not in ranks, k)) if room > 1 else 0
        strand, canonical = ranks.get(k, (None, False))
    else:
        k = int(total.argmin())
        if gap:
            size = abs(gap)
            total = total + (s.ref_gap_open + s.ref_gap_extend * size if gap < 0 else s.read_gap_open + s.read_gap_extend * size)
    edits = [{"pos": int(i), "type": "mm", "ref": left_ref[i], "read": read[i], "length": 1, "snp": None} for i in range(k) if read[i] != left_ref[i]]
    if kind == "ins":
        edits.append({"pos": k, "type": "ins", "ref": "", "read": read[k : k + lost], "length": lost, "snp": None})
    elif kind in ("del", "spl"):
        edits.append({"pos": k, "type": kind, "ref": left_ref[k : k + gap] if kind == "del" else "", "read": "", "length": gap, "snp": None})
    for i in range(k, room):
        if a[lost + i] != right[i]:
            edits.append({"pos": lost + i, "type": "mm", "ref": chr(right[i]), "read": read[lost + i], "length": 1, "snp": None})
    return {"score": -int(total[k]), "break": k, "kind": kind, "strand": strand, "canonical": canonical, "edits": edits}


def one_gap(s_: str, t: str, gap: int) -> tuple[int, int]:
    """(mismatches, place) of the best single gap: gap > 0 letters are missing in s_, gap < 0 in t."""
    long, short = (t, s_) if gap > 0 else (s_, t)
    size = abs(gap)
    n = min(len(short), len(long) - size)
    a, b = np.frombuffer(short.encode(), np.uint8)[:n], np.frombuffer(long.encode(), np.uint8)
    before = np.concatenate([[0], np.cumsum(a != b[:n])])
    after = np.concatenate([np.cumsum((a != b[size : size + n])[::-1])[::-1], [0]])
    k = int((before + after).argmin())
    return int((before + after)[k]), k


def edit_limit(a: str, b: str, limit: int) -> int:
    """Mismatches of two strings of one length, limit + 1 if there are more."""
    return min(limit + 1, sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b)))


def clip_penalties(qual: str | None, n: int, s: Scoring) -> np.ndarray:
    """Penalty of each read base if it is clipped."""
    if s.ignore_quals or not qual:
        return np.full(n, s.clip_max, np.int64)
    q = np.clip(np.frombuffer(qual.encode(), np.uint8).astype(np.int64) - 33, 0, 40)
    return s.clip_min + (q / 40.0 * (s.clip_max - s.clip_min)).astype(np.int64)


def edit_cost(e: dict, pen: np.ndarray, s: Scoring) -> int:
    """What an edit costs; introns nothing."""
    if e["type"] == "mm":
        return int(pen[e["pos"]]) if e["ref"] in "ACGT" and e["read"] in "ACGT" else s.n_penalty
    if e["type"] == "ins":
        return s.ref_gap_open + s.ref_gap_extend * e["length"]
    return s.read_gap_open + s.read_gap_extend * e["length"] if e["type"] == "del" else 0


def clip_ends(read: str, qual: str | None, score: int, start: int, edits: list, s: Scoring = Scoring()) -> tuple[int, int, int, int, list]:
    """An end-to-end alignment with each end clipped where that costs less than the edits it takes away: (score, start in ref, left clip, right clip, edits). Introns are not clipped away, and a base stays at least."""
    n = len(read)
    pen, clip = penalties(qual, n, s), np.concatenate([[0], np.cumsum(clip_penalties(qual, n, s))])
    order = sorted(edits, key=lambda e: e["pos"])
    introns = [k for k, e in enumerate(order) if e["type"] == "spl"]
    width = lambda e: e["length"] if e["type"] == "ins" else 1 if e["type"] == "mm" else 0
    # (gain, clipped bases, edits before or up to which they reach) of each way to clip an end
    lefts, rights, saved = [(0, 0, 0)], [(0, 0, len(order))], 0
    for k, e in enumerate(order[: introns[0]] if introns else order):
        saved += edit_cost(e, pen, s)
        at = e["pos"] + width(e)
        lefts.append((saved - int(clip[at]), at, k + 1))
    saved = 0
    for k in range(len(order) - 1, introns[-1] if introns else -1, -1):
        saved += edit_cost(order[k], pen, s)
        rights.append((saved - int(clip[n] - clip[order[k]["pos"]]), n - order[k]["pos"], k))
    pairs = ((a[0] + b[0], -a[1] - b[1], a, b) for a in lefts for b in rights if a[1] + b[1] < n and a[2] <= b[2])
    (gain_left, left, first), (gain_right, right, last) = max(pairs, key=lambda x: x[:2])[2:]
    gone = sum(e["length"] if e["type"] == "del" else -e["length"] if e["type"] == "ins" else 0 for e in order[:first])
    return score + gain_left + gain_right, start + left + gone, left, right, [e | {"pos": e["pos"] - left} for e in order[first:last]]


def clip_diagonal(read: str, ref: str, qual: str | None, s: Scoring = Scoring()) -> tuple[int, int, int, int, list]:
    """Best ungapped alignment of a read to reference bases of its length with its ends clipped, as clip_ends()."""
    n = len(read)
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in (read, ref))
    known = np.isin(a, list(b"ACGT")) & np.isin(b, list(b"ACGT"))
    cost = np.concatenate([[0], np.cumsum(np.where(~known, s.n_penalty, np.where(a == b, -s.match, penalties(qual, n, s))))])
    clip = np.concatenate([[0], np.cumsum(clip_penalties(qual, n, s))])
    # bases [i, j) are kept: clip[i] - cost[i] + cost[j] + (clip[n] - clip[j])
    begin = np.minimum.accumulate((clip - cost)[:n])
    total = begin + (cost - clip)[1:] + clip[n]
    j = int(n - total[::-1].argmin())
    i = int((clip - cost)[:j].argmin())
    edits = [{"pos": int(k), "type": "mm", "ref": ref[i + k], "read": read[i + k], "length": 1, "snp": None} for k in np.flatnonzero(a[i:j] != b[i:j])]
    return -int(total[j - 1]), i, i, n - j, edits


_SCHEMA = f"score int, ref_start int, left_clip int, edits array<{EDIT}>"
_CLIPPED = f"score int, ref_start int, left_clip int, right_clip int, edits array<{EDIT}>"


def _once(run, *columns: list) -> list:
    """run() of the distinct rows of columns, for every row: the places of a read in repeats often have the same bases around them."""
    first: dict[tuple, int] = {}
    at = [first.setdefault(row, len(first)) for row in zip(*columns, strict=True)]
    found = run(*map(list, zip(*first, strict=True))) if first else []
    return [found[k] for k in at]


def local_diagonal(read: str, ref: str, qual: str | None, s: Scoring = Scoring()) -> tuple[int, int, int, int, list]:
    """Best part of a read on reference bases of its length without gaps, as affine_ends() scores it."""
    n = len(read)
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in (read, ref))
    known = np.isin(a, list(b"ACGT")) & np.isin(b, list(b"ACGT"))
    total = np.concatenate([[0], np.cumsum(np.where(~known, -s.n_penalty, np.where(a == b, s.match or 2, -penalties(qual, n, s))))])
    gained = total - np.minimum.accumulate(total)
    j = int(gained.argmax())
    i = int(np.flatnonzero(gained[: j + 1] == 0)[-1])
    edits = [{"pos": int(k), "type": "mm", "ref": ref[i + k], "read": read[i + k], "length": 1, "snp": None} for k in np.flatnonzero(a[i:j] != b[i:j])]
    return int(gained[j]), i, i, n - j, edits


def shares_cell(best: tuple, own: tuple, n: int) -> bool:
    """Whether two alignments (score, start in ref, left clip, right clip, edits) of a read of n bases, of which own has no gaps, put a base at one place."""
    _, start, left, right, edits = best
    diagonal, first, last = own[1] - own[2], own[2], n - own[3]
    d, at = start - left, left
    for e in edits:
        if e["type"] in ("ins", "del"):
            if d == diagonal and max(at, first) < min(left + e["pos"], last):
                return True
            at, d = left + e["pos"] + (e["length"] if e["type"] == "ins" else 0), d + (e["length"] if e["type"] == "del" else -e["length"])
    return d == diagonal and max(at, first) < min(n - right, last)


def with_own(best: tuple, own: tuple | None, n: int, always: bool) -> list[tuple]:
    """The best alignment in a candidate's window, and the one on the candidate's own diagonal: a place that ties with the best one, or is worse, is a place of its own. Where both put a base at one place they are one alignment, and the better one counts; always: both stay."""
    if own is None or best[1:] == own[1:]:
        return [best]
    if not shares_cell(best, own, n):
        return [best, own]
    return [best, own] if always else [max(best, own, key=lambda x: x[0])]


def _told(frame: pd.DataFrame, names: list[str], found: list[list[tuple]], columns: list[str]) -> pd.DataFrame:
    """Rows of frame, each as often as it has alignments in found, beside them."""
    rows = np.repeat(np.arange(len(frame)), [len(x) for x in found])
    told = pd.DataFrame([y for x in found for y in x], columns=columns)
    return pd.concat([frame[names].iloc[rows].reset_index(drop=True), told], axis=1)


def clip_candidates(candidates: DataFrame, s: Scoring = Scoring(), local: bool = False, always: bool = False) -> DataFrame:
    """Adds score, ref_start, left_clip, right_clip and edits to candidates (read, qual, window, lead: where the read's diagonal begins in the window), a row for each of with_own().

    Local: the best part of the read, matches count. Else clipped bases cost their penalty: the gapped
    alignment with clipped ends, and the diagonal alone.
    """
    names = candidates.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", " + _CLIPPED

    def gapped(reads: list[str], windows: list[str], quals: list) -> list[tuple]:
        if local:
            return [affine_ends(r, w, q, s, True) if r and w else (_LOW, 0, 0, 0, []) for r, w, q in zip(reads, windows, quals, strict=True)]
        out = []
        for read, qual, (score, start, _, edits) in zip(reads, quals, affine_all(reads, windows, quals, s), strict=True):
            out.append(clip_ends(read, qual, score, start, edits, s) if edits else (score, start, 0, 0, edits))
        return out

    def both(reads: list[str], windows: list[str], quals: list, leads: list[int]) -> list[list[tuple]]:
        out = []
        for read, window, qual, lead, best in zip(reads, windows, quals, leads, _once(gapped, reads, windows, quals), strict=True):
            own = None
            if read and lead >= 0 and lead + len(read) <= len(window):
                own = (local_diagonal if local else clip_diagonal)(read, window[lead : lead + len(read)], qual, s)
                own = (own[0], own[1] + lead, *own[2:])
            out.append(with_own(best, own, len(read), always))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = _once(both, [x or "" for x in frame.read], [x or "" for x in frame.window], list(frame.qual), [int(x) for x in frame.lead])
            yield _told(frame, names, found, ["score", "ref_start", "left_clip", "right_clip", "edits"])

    return candidates.mapInPandas(run, schema)


def align_candidates(candidates: DataFrame, s: Scoring = Scoring(), local: bool = False, fixed_ends: bool = False, always: bool = False) -> DataFrame:
    """Adds score, ref_start, left_clip and edits to candidates (read, qual, window: the reference bases around the place); fixed_ends: the whole window is aligned. With a lead (where the read's diagonal begins in the window) a row for each of with_own()."""
    names = candidates.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", " + _SCHEMA
    leads = "lead" in names and not local and not fixed_ends

    def own_too(read: str, window: str, qual: str | None, lead: int, best: tuple) -> list[tuple]:
        n = len(read)
        if not n or lead < 0 or lead + n > len(window) or (not best[3] and best[1] == lead):
            return [best]
        score, edits = ungapped(read, window[lead : lead + n], qual, s)
        told = with_own((*best[:3], 0, best[3]), (score, lead, 0, 0, edits), n, always)
        return [(*x[:3], x[4]) for x in told]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            reads, windows, quals = [x or "" for x in frame.read], [x or "" for x in frame.window], list(frame.qual)
            best = _once(lambda *x: affine_all(*x, s, local, fixed_ends), reads, windows, quals)
            found = [own_too(*x) for x in zip(reads, windows, quals, [int(x) for x in frame.lead], best, strict=True)] if leads else [[x] for x in best]
            yield _told(frame, names, found, ["score", "ref_start", "left_clip", "edits"])

    return candidates.mapInPandas(run, schema)


def combine_candidates(pairs: DataFrame, s: Scoring = Scoring()) -> DataFrame:
    """Adds join_score, kind, strand, canonical, edits to pairs (read, qual, left_ref, right_ref, gap); pairs that cannot be joined are dropped."""
    names = pairs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + f", join_score int, kind string, strand string, canonical boolean, edits array<{EDIT}>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [combine(r, a, b, int(g), s, q) for r, q, a, b, g in zip(frame.read, frame.qual, frame.left_ref, frame.right_ref, frame.gap, strict=True)]
            kept = [x is not None for x in found]
            told = pd.DataFrame([(x["score"], x["kind"], x["strand"], x["canonical"], x["edits"]) for x in found if x], columns=["join_score", "kind", "strand", "canonical", "edits"])
            yield pd.concat([frame.loc[kept, names].reset_index(drop=True), told], axis=1)

    return pairs.mapInPandas(run, schema)
