"""CIGAR strings, MD strings and edit lists.

An edit is (pos, type, ref, read, length): pos counts read bases from the left end; types are
``mm`` (mismatch), ``del`` (reference bases missing in the read), ``ins`` (read bases missing in the
reference) and ``spl`` (an intron of length bases before pos); ``snp`` names a known variant or is null.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDIT = "struct<pos:int,type:string,ref:string,read:string,length:int,snp:string>"
EDIT_TYPE = T.StructType([T.StructField(n, T.IntegerType() if n in ("pos", "length") else T.StringType()) for n in ("pos", "type", "ref", "read", "length", "snp")])


def cigar_ops(cigar: Column) -> Column:
    """Array of (len, op)."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\d+", 0).cast("int").alias("len"), F.substring(p, -1, 1).alias("op")))


def _sum_of(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def reference_span(cigar: Column) -> Column:
    return _sum_of(cigar, "MDN=X")


def read_span(cigar: Column) -> Column:
    return _sum_of(cigar, "MIS=X")


def cigar_end(pos: Column, cigar: Column) -> Column:
    """Last reference place of an alignment that starts at pos."""
    return pos + reference_span(cigar) - 1


def clip(cigar: Column, left: bool = True) -> Column:
    """Soft-clipped bases on one side."""
    return F.coalesce(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S" if left else r"(\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0))


def cigar_junctions(pos: Column, cigar: Column, min_anchor: int = 0) -> Column:
    """Array of (left, right), the reference places that flank each intron, where both neighbouring matches have min_anchor bases."""
    ops = cigar_ops(cigar)
    start = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<left:long,right:long>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        x = F.element_at(ops, i)
        before, after = F.try_element_at(ops, F.when(i > 1, i - 1).otherwise(i)), F.try_element_at(ops, i + 1)
        wide = (F.coalesce(before["len"], F.lit(0)) >= min_anchor) & (F.coalesce(after["len"], F.lit(0)) >= min_anchor)
        found = F.struct((acc["at"] - 1).alias("left"), (acc["at"] + x["len"]).alias("right"))
        moved = F.when(x["op"].isin("M", "D", "N", "=", "X"), acc["at"] + x["len"]).otherwise(acc["at"])
        return F.struct(moved.alias("at"), F.when((x["op"] == "N") & wide, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    places = F.when(F.size(ops) > 0, F.sequence(F.lit(1), F.size(ops))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda acc: acc["out"])


def build_cigar(length: int, edits: list, left_clip: int = 0, right_clip: int = 0, extended: bool = False) -> str:
    """CIGAR of a read of length aligned bases (clips apart) with its edits."""
    runs: list[list] = []

    def put(n: int, op: str) -> None:
        if n > 0:
            if runs and runs[-1][1] == op:
                runs[-1][0] += n
            else:
                runs.append([n, op])

    put(left_clip, "S")
    at, same = 0, "=" if extended else "M"
    for e in sorted(edits, key=lambda e: (e["pos"], e["type"] != "spl")):
        put(e["pos"] - at, same)
        at = max(at, e["pos"])
        if e["type"] == "mm":
            put(1, "X" if extended else "M")
            at += 1
        elif e["type"] == "ins":
            put(e["length"], "I")
            at += e["length"]
        else:
            put(e["length"], "D" if e["type"] == "del" else "N")
    put(length - at, same)
    put(right_clip, "S")
    return "".join(f"{n}{op}" for n, op in runs) or "*"


def build_md(length: int, edits: list) -> str:
    """MD string: introns and insertions are skipped, every mismatch and deletion is spelled."""
    out, run, at, gone = [], 0, 0, False
    for e in sorted(edits, key=lambda e: (e["pos"], e["type"] != "spl")):
        run += e["pos"] - at
        at = e["pos"]
        if e["type"] == "mm":
            out.append(f"{run}{e['ref']}" if run or not gone else f"0{e['ref']}")
            run, at, gone = 0, at + 1, False
        elif e["type"] == "del":
            out.append(f"{run}^{e['ref']}")
            run, gone = 0, True
        elif e["type"] == "ins":
            at += e["length"]
    return "".join(out) + str(run + length - at)


def reference_side(read: str, edits: list) -> str:
    """The reference bases that an alignment of the read covers (introns left out)."""
    out, at = [], 0
    for e in sorted(edits, key=lambda e: (e["pos"], e["type"] != "spl")):
        out.append(read[at : e["pos"]])
        at = e["pos"]
        if e["type"] == "mm":
            out.append(e["ref"])
            at += 1
        elif e["type"] == "del":
            out.append(e["ref"])
        elif e["type"] == "ins":
            at += e["length"]
    return "".join(out) + read[at:]


def left_align(read: str, edits: list) -> list:
    """Slides each gap left while the letters allow, up to the edit before it; gaps of known variants stay."""
    out: list = []
    for e in sorted(edits, key=lambda e: e["pos"]):
        e = dict(e)
        if e["type"] in ("del", "ins") and not e.get("snp"):
            last = out[-1] if out else None
            floor = 0 if last is None else last["pos"] + (last["length"] if last["type"] == "ins" else 1 if last["type"] == "mm" else 0)
            gap = e["ref"] if e["type"] == "del" else e["read"]
            while e["pos"] > floor and read[e["pos"] - 1] == gap[-1]:
                gap = gap[-1] + gap[:-1]
                e["pos"] -= 1
            e["ref" if e["type"] == "del" else "read"] = gap
        out.append(e)
    return out


def invert(edits: list, length: int) -> list:
    """The same edits counted from the other end of a read of length bases; letters stay as they are."""
    return [dict(e) | {"pos": length - e["pos"] - (e["length"] if e["type"] == "ins" else 1 if e["type"] == "mm" else 0)} for e in reversed(edits)]


def inverted(edits: Column, length: Column) -> Column:
    """invert() as a column."""
    width = lambda e: F.when(e["type"] == "ins", e["length"]).when(e["type"] == "mm", 1).otherwise(0)
    return F.transform(F.reverse(edits), lambda e: e.withField("pos", (length - e["pos"] - width(e)).cast("int")))


def edits_of(read: str, cigar: str, md: str) -> list:
    """Edits from a read, its CIGAR and MD (clips are cut off first)."""
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    if ops and ops[0][1] == "S":
        read = read[ops[0][0] :]
    marks = re.findall(r"(\d+)|\^([A-Z]+)|([A-Z])", md)
    letters: list[tuple[str, str]] = []
    for n, gone, base in marks:
        letters += [("", "")] * int(n) if n else [("del", gone)] if gone else [("mm", base)]
    out, at, k = [], 0, 0
    for n, op in ops:
        if op in "M=X":
            for _ in range(n):
                kind, base = letters[k]
                if kind == "mm":
                    out.append({"pos": at, "type": "mm", "ref": base, "read": read[at], "length": 1, "snp": None})
                k, at = k + 1, at + 1
        elif op == "I":
            out.append({"pos": at, "type": "ins", "ref": "", "read": read[at : at + n], "length": n, "snp": None})
            at += n
        elif op == "D":
            out.append({"pos": at, "type": "del", "ref": letters[k][1], "read": "", "length": n, "snp": None})
            k += 1
        elif op == "N":
            out.append({"pos": at, "type": "spl", "ref": "", "read": "", "length": n, "snp": None})
    return out


def compose(consensus: str, read: str, pos: int, edits: list, copy_edits: list) -> tuple[int, list]:
    """(place in the copy, edits) of a read on a copy of a consensus, from its place and edits on the consensus, and the edits of the consensus on the copy.

    Both edit lists are laid out base by base and merged: what either inserts or leaves out stays so,
    a base that both leave out vanishes, and letters are compared with the copy's own.
    """
    # the copy's letter under each base of the consensus ("" where it has none), and its bases before each
    under, extra = list(consensus), [""] * (len(consensus) + 1)
    for e in copy_edits:
        if e["type"] == "mm":
            under[e["pos"]] = e["ref"]
        elif e["type"] == "ins":
            under[e["pos"] : e["pos"] + e["length"]] = [""] * e["length"]
        else:
            extra[e["pos"]] += e["ref"]
    gaps = {(e["pos"], e["type"]): e for e in edits if e["type"] in ("ins", "del")}
    columns, at, k = [], pos, 0  # (read letter or "", copy letter or "")
    while True:
        if e := gaps.pop((k, "del"), None):
            for c in range(at, at + e["length"]):
                columns += [("", x) for x in (extra[c] if c > pos else "")] + [("", under[c])]
            at += e["length"]
        if e := gaps.pop((k, "ins"), None):
            columns += [(x, "") for x in read[k : k + e["length"]]]
            k += e["length"]
            continue
        if k >= len(read):
            break
        columns += [("", x) for x in (extra[at] if at > pos else "")] + [(read[k], under[at])]
        at, k = at + 1, k + 1
    start = sum(len(x) for x in under[:pos]) + sum(map(len, extra[: pos + 1]))
    columns = [c for c in columns if c != ("", "")]
    while columns and not columns[0][0]:
        columns, start = columns[1:], start + 1
    while columns and not columns[-1][0]:
        columns.pop()
    out, k = [], 0
    for mine, other in columns:
        kind = "del" if not mine else "ins" if not other else "mm" if mine != other else ""
        last = out[-1] if out else None
        if kind in ("del", "ins") and last and last["type"] == kind and last["pos"] + (last["length"] if kind == "ins" else 0) == k:
            out[-1] = last | {"ref": last["ref"] + other, "read": last["read"] + mine, "length": last["length"] + 1}
        elif kind:
            out.append({"pos": k, "type": kind, "ref": other, "read": mine, "length": 1, "snp": None})
        k += bool(mine)
    return start, out


def edit_rows(edits) -> list:
    return [] if edits is None else [dict(e) if isinstance(e, dict) else e.asDict() for e in edits]


@F.pandas_udf(T.StringType())
def cigar_of(length: pd.Series, edits: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([build_cigar(int(n), edit_rows(e), int(a), int(b)) for n, e, a, b in zip(length, edits, left, right, strict=True)])


@F.pandas_udf(T.StringType())
def md_of(length: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([build_md(int(n), edit_rows(e)) for n, e in zip(length, edits, strict=True)])


@F.pandas_udf(T.StringType())
def reference_of(read: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([reference_side(r, edit_rows(e)) for r, e in zip(read, edits, strict=True)])


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of strings laid end to end, where each begins, and how long each is (0 if null)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer("".join(x or "" for x in texts.to_pylist()).encode(), np.uint8)
    return data, np.cumsum(size) - size, size


@F.arrow_udf(T.ArrayType(EDIT_TYPE))
def left_aligned(read: pa.Array, edits: pa.Array) -> pa.Array:
    """left_align() of a batch: the first edits of all rows are slid together, letter by letter, then the second ones, and so on."""
    sizes = pc.fill_null(pc.list_value_length(edits), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows, flat = np.repeat(np.arange(len(edits)), sizes), edits.flatten()
    flat = flat.take(pa.array(np.lexsort((flat.field("pos").to_numpy(zero_copy_only=False), rows))))
    fields = {name: flat.field(name) for name in EDIT_TYPE.names}
    is_a = lambda kind: pc.fill_null(pc.equal(fields["type"], kind), False).to_numpy(zero_copy_only=False)
    gone, put, changed = is_a("del"), is_a("ins"), is_a("mm")
    slides = (gone | put) & (pc.fill_null(pc.utf8_length(fields["snp"]), 0).to_numpy(zero_copy_only=False) == 0)
    gaps = pc.if_else(pa.array(gone), fields["ref"], fields["read"])
    (text, begins, long), (gap, gap_begins, wide) = _letters(read), _letters(gaps)
    at = fields["pos"].to_numpy(zero_copy_only=False).astype(np.int64)
    # gaps of no letters or past the end, and letters of several bytes, are left to the plain version
    if (slides & ((wide == 0) | (at > long[rows]))).any() or (text > 127).any() or (gap > 127).any():
        return pa.array([left_align(r, edit_rows(e)) for r, e in zip(read.to_pylist(), edits.to_pylist(), strict=True)], edits.type)
    width = np.where(put, pc.fill_null(fields["length"], 0).to_numpy(zero_copy_only=False), changed)
    rank, moved = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows], np.zeros(len(rows), np.int64)
    for k in range(int(sizes.max(initial=0))):
        on = np.flatnonzero((rank == k) & slides)
        floor = at[on - 1] + width[on - 1] if k else np.zeros(len(on), np.int64)
        n = 0
        while True:
            stays = at[on] > floor
            on, floor = on[stays], floor[stays]
            same = text[begins[rows[on]] + at[on] - 1] == gap[gap_begins[on] + wide[on] - 1 - n % np.maximum(wide[on], 1)]
            on, floor, n = on[same], floor[same], n + 1
            if not len(on):
                break
            at[on] -= 1
            moved[on] += 1
    if moved.any():
        # a gap that slid has its last letters in front
        inside = np.arange(len(gap)) - np.repeat(gap_begins, wide)
        turned = gap[np.repeat(gap_begins, wide) + (inside - np.repeat(moved, wide)) % np.repeat(wide, wide)].tobytes()
        turned = pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.append(gap_begins, len(gap)).astype(np.int32)), pa.py_buffer(turned))
        for name, kind in (("ref", gone), ("read", put)):
            fields[name] = pc.if_else(pa.array(kind & (moved > 0)), turned, fields[name])
    fields["pos"] = pa.array(at, pa.int32())
    whole = pa.StructArray.from_arrays(list(fields.values()), names=EDIT_TYPE.names)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), whole)
