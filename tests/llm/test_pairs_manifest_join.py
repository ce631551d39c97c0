"""Operators 11 to 13 against plain Python on awkward rows and on the small tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from cases import documents, edited, prose, rows, shaped
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import jaccard_tree, merkle, registry, tokenizer_pairs
from seqloom.llm.near_dup import WordHashes, shingle_set, words_of

EMPTY: list = []
SMALL = "/root/testdata/sf0.001"


def told(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11: cross-tokenizer alignment --------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(registry.TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=registry.PIECES)


def byte_of():
    """GPT-2 style stand-ins of bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute_tokens(text, tokenizers):
    """(id, begin, end) of both sides, one byte range at a time."""
    if not text:
        return [], []
    a, b = tokenizers
    stand_in, spelled = byte_of(), (" " + text).encode()
    token_a = [(k, bytes(stand_in[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    token_b = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
    if b"".join(x for _, x in token_a) != spelled or b"".join(x for _, x in token_b) != spelled:
        return [], []
    out = []
    for side in (token_a, token_b):
        at, found = 0, []
        for k, x in side:
            found.append((k, at, at + len(x)))
            at += len(x)
        out.append(found)
    return out


def brute_links(a, b):
    """Two pointers over the tokens."""
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((i, j, a[i][0], b[j][0], max(a[i][1], b[j][1]), min(a[i][2], b[j][2])))
        end = min(a[i][2], b[j][2])
        i, j = i + (a[i][2] == end), j + (b[j][2] == end)
    return out


def brute_groups(a, b):
    ends, out, i, j, start = {x[2] for x in b}, [], 0, 0, 0
    for k, token in enumerate(a):
        if token[2] in ends:
            m = j
            while b[m][2] < token[2]:
                m += 1
            out.append(([x[0] for x in a[i : k + 1]], [x[0] for x in b[j : m + 1]], start, token[2]))
            i, j, start = k + 1, m + 1, token[2]
    return out


def brute_alignment(data, tokenizers):
    linked = [brute_links(*brute_tokens(t, tokenizers)) for _, t in data]
    count = collections.Counter(p for x in linked for p in {(k[2], k[3]) for k in x})
    best_a, best_b = collections.Counter(), collections.Counter()
    for (a, b), n in count.items():
        best_a[a], best_b[b] = max(best_a[a], n), max(best_b[b], n)
    out = []
    for (d, t), x in zip(data, linked, strict=True):
        a, b = brute_tokens(t, tokenizers)
        g = brute_groups(a, b)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _, _ in g)
        n = [count[k[2], k[3]] for k in x]
        out.append((d, len(a), len(b), len(g), len(x), sum(v == best_a[k[2]] for v, k in zip(n, x, strict=True)), sum(v == best_b[k[3]] for v, k in zip(n, x, strict=True)), sum(n), sha(text) if a else ""))
    return out


def order(x):
    return tuple((v is not None, v) for v in x)


TEXTS = ["<|endoftext|> and <s> are text </s>", "naïve café — 你好, мир 🙂🙂", "tab\tand\nline\n\n end ", "  leading", "a▁b", "x" * 3000, "ﬁne ½ é", "<0x41> \x00 ​", "word " * 4000, "　wide"]


def test_alignment_against_brute_force(spark, tokenizers, monkeypatch):
    data = [(d, t) for d, t, _, _ in rows()] + [(900 + k, t) for k, t in enumerate(TEXTS)]
    df = documents(spark, [(d, t, None, None) for d, t in data])
    want = sorted(brute_alignment(data, tokenizers), key=order)
    assert sorted(map(tuple, tokenizer_pairs.align(df, registry.TOKENIZER, registry.PIECES).collect()), key=order) == want
    monkeypatch.setattr(tokenizer_pairs, "CHUNK_TOKENS", 700)
    monkeypatch.setattr(tokenizer_pairs, "MERGE_CHARS", 300)
    assert sorted(map(tuple, tokenizer_pairs.align(df, registry.TOKENIZER, registry.PIECES).collect()), key=order) == want
    assert tokenizer_pairs.align(documents(spark, EMPTY), registry.TOKENIZER, registry.PIECES).count() == 0


def test_groups_links_and_counts(spark, tokenizers):
    data = [(k, t) for k, t in enumerate(TEXTS) if len(t) < 100]
    df = documents(spark, [(d, t, None, None) for d, t in data])
    found = collections.defaultdict(list)
    for r in told(tokenizer_pairs.links(df, registry.TOKENIZER, registry.PIECES)):
        found[r["doc_id"]].append((r["a_at"], r["b_at"], r["a_id"], r["b_id"], r["first_byte"], r["end_byte"]))
    cut = collections.defaultdict(list)
    for r in told(tokenizer_pairs.groups(df, registry.TOKENIZER, registry.PIECES).orderBy("doc_id", "group")):
        assert r["group"] == len(cut[r["doc_id"]])
        cut[r["doc_id"]].append((r["a"], r["b"], r["first_byte"], r["end_byte"]))
    count = collections.Counter()
    for d, t in data:
        a, b = brute_tokens(t, tokenizers)
        assert sorted(found[d]) == brute_links(a, b)
        assert cut[d] == brute_groups(a, b)
        count.update({(x[2], x[3]) for x in found[d]})
    got = told(tokenizer_pairs.pair_counts(df, registry.TOKENIZER, registry.PIECES))
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in got} == dict(count)
    assert all(r["best_a"] == max(n for (a, _), n in count.items() if a == r["a_id"]) and r["best_b"] == max(n for (_, b), n in count.items() if b == r["b_id"]) for r in got)


def test_alignment_of_a_table_and_long_white_space(spark, tokenizers):
    got = sorted(map(tuple, registry.op11_tokenizer_alignment(spark, SMALL).drop("n_best_b").collect()))
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted((*x[:6], *x[7:]) for x in brute_alignment(data, tokenizers))
    data = [(1, "a" + " " * 1_100_000 + "b"), (2, "fine")]
    got = {r["doc_id"]: r for r in told(tokenizer_pairs.align(spark.createDataFrame(data, "doc_id long, text string"), registry.TOKENIZER, registry.PIECES))}
    a, b = (x for x in brute_tokens(data[0][1], tokenizers))
    assert (got[1]["n_a"], got[1]["n_b"]) == (len(a), len(b)) and got[2]["n_a"] > 0


# ---- 12: Merkle manifest ------------------------------------------------------------------------


def brute_manifest(data, columns=merkle.FIELDS, fan=8):
    """data: dicts of the fields."""

    def leaf(r):
        return sha("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in columns))

    def tree(digests):
        """The top, and for each leaf its (slot, others) level by level."""
        paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
        while len(level) > 1:
            for k, p in enumerate(paths):
                low = at[k] // fan * fan
                run = level[low : low + fan]
                p.append((at[k] - low, run[: at[k] - low] + run[at[k] - low + 1 :]))
                at[k] //= fan
            level = [sha("".join(level[k : k + fan])) for k in range(0, len(level), fan)]
        return level[0] if level else None, paths

    groups = collections.defaultdict(list)
    for r in data:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    root, above = tree([x[0] for x in below])
    out = []
    for g, (subroot, paths), up in zip(names, below, above, strict=True):
        for (_, _, digest, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            now = digest
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                now = leaf(r | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])})
            for slot, others in path + up:
                now = sha("".join([*others[:slot], now, *others[slot:]]))
            out.append((r["doc_id"], digest, subroot, root, sha("".join(d for _, others in path + up for d in others)), now, now == root))
    return out


def check_manifest(spark, df, data):
    got = sorted(map(tuple, merkle.verify(merkle.leaves_of(df)).collect()), key=order)
    assert got == sorted(brute_manifest(data), key=order)
    return got


def test_manifest_against_brute_force(spark):
    df = shaped(documents(spark))
    data = [dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) | {"n_chars": None if r[1] is None else len(r[1])} for r in rows()]
    got = check_manifest(spark, df, data)
    assert {x[-1] for x in got} == {True, False}
    for n in (1, 8, 9, 65):  # one language, at the edges of a run
        some = [{"doc_id": k * 7, "text": f"Text {k}", "lang": "en", "source": None, "n_chars": k} for k in range(n)]
        check_manifest(spark, spark.createDataFrame([tuple(r[c] for c in merkle.FIELDS) for r in some], "doc_id long, source string, lang string, n_chars long, text string"), some)
    assert merkle.verify(merkle.leaves_of(shaped(documents(spark, EMPTY)))).count() == 0


def test_manifest_of_a_table(spark):
    data = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(map(tuple, registry.op12_merkle_manifest(spark, SMALL).collect()))
    assert got == sorted(brute_manifest(data))


def test_many_groups_and_levels(spark):
    data = [{"doc_id": k, "text": "Aa", "lang": None if k % 5 == 0 else "" if k % 5 == 1 else f"l{k % 90}", "source": "s", "n_chars": 2} for k in range(700)]
    check_manifest(spark, spark.createDataFrame([tuple(r[c] for c in merkle.FIELDS) for r in data], "doc_id long, source string, lang string, n_chars long, text string").repartition(5), data)


def test_a_parent_that_lacks_a_child_is_told(spark):
    nodes = spark.createDataFrame([(1, k, 4, b"x" * 32) for k in (0, 1, 3)], "tree long, place long, n long, digest binary")
    with pytest.raises(Exception, match="has not got every child once"):
        merkle._up(nodes, 3).collect()


# ---- 13: n-gram Jaccard join --------------------------------------------------------------------


def brute_classes(data, percent=80):
    def shingles(text):
        w = text.lower().split() if text else []
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(d, shingles(t)) for d, t in data]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if a and b and (a == b or None not in (d, e)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=order)


def ladder(n, length, seed):
    """Texts in which each is like its neighbours only: a chain of edits."""
    now, out = prose(seed, length).split(), []
    rng = random.Random(seed)
    for k in range(n):
        out.append(" ".join(now))
        at = rng.randrange(length - 4)
        now[at : at + 3] = [f"e{seed}x{k}y{j}" for j in range(3)]
    return out


def test_jaccard_classes_against_brute_force(spark):
    data = [(d, t) for d, t, _, _ in rows()] + [(1000 + k, t) for k, t in enumerate(ladder(25, 60, 3))] + [(2000 + k, edited(prose(9, 120), k, 0.02 + 0.03 * (k % 4))) for k in range(30)]
    got = sorted(map(tuple, jaccard_tree.jaccard_classes(documents(spark, [(d, t, None, None) for d, t in data])).collect()), key=order)
    assert got == brute_classes(data)
    assert jaccard_tree.jaccard_classes(documents(spark, EMPTY)).count() == 0


def test_jaccard_classes_with_small_branches_and_common_shingles(spark, monkeypatch):
    """Trees of several branches, and shingles that stand behind the others."""
    monkeypatch.setattr(jaccard_tree, "BRANCH", 7)
    monkeypatch.setattr(jaccard_tree, "COMMON_SETS", 5)
    monkeypatch.setattr(jaccard_tree, "FAMILY", 6)
    shared = prose(50, 30)
    data = [(k, f"{prose(600 + k, 40 + k % 9)} {shared}") for k in range(40)] + [(100 + k, t) for k, t in enumerate(ladder(40, 50, 4))] + [(300 + k, edited(prose(9, 120), k, 0.05)) for k in range(40)] + [(500, shared), (501, shared + " more")]
    df = documents(spark, [(d, t, None, None) for d, t in data])
    want = brute_classes(data)
    assert sorted(map(tuple, jaccard_tree.jaccard_classes(df).collect()), key=order) == want
    monkeypatch.setattr(jaccard_tree, "COMMON_SETS", 10**6)
    assert sorted(map(tuple, jaccard_tree.jaccard_classes(df).collect()), key=order) == want


def test_jaccard_classes_of_a_table(spark):
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.op13_ngram_jaccard(spark, SMALL).collect())) == brute_classes(data)


def test_rows_of_one_doc_id_with_two_texts(spark):
    base = prose(1, 40)
    data = [(1, base), (1, "quite another text that is not like it"), (2, base + " more"), (3, "quite another text that is not like it at"), (None, base), (None, "nothing is like this text")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_tree.jaccard_classes(df).collect()), key=order)
    assert got == brute_classes(data)


def test_traversal_finds_every_pair_that_may_link():
    rng = np.random.default_rng(5)
    hashes = WordHashes()
    texts = [edited(prose(k % 9, 50 + 10 * (k % 3)), k, 0.04) for k in range(120)]
    sets = [shingle_set(words_of(t), hashes) for t in texts]
    root = rng.integers(0, 100, len(sets))
    branch = sorted(range(len(sets)), key=lambda k: (root[k], len(sets[k])))
    branch = [np.array(branch), root[branch], np.array([len(sets[k]) for k in branch]), np.array([jaccard_tree.bitmap(sets[k]).tobytes() for k in branch], object)]
    half = [[x[:70] for x in branch], [x[70:] for x in branch]]
    want = {(i, j) for i in range(120) for j in range(i) if root[i] != root[j] and 100 * len(s := np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(s))}
    pairs = lambda found: {(max(i, j), min(i, j)) for a, b in found for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    whole = pairs(jaccard_tree.pairs_between(branch))
    assert want and want <= whole and len(whole) < 120 * 119 // 4
    assert want <= pairs(jaccard_tree.pairs_between(half[0])) | pairs(jaccard_tree.pairs_between(half[1])) | pairs(jaccard_tree.pairs_between(*half))


def test_front_of_sets():
    rng = np.random.default_rng(6)
    common = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    rank = {int(x): k for k, x in enumerate(common)}
    for n in (0, 1, 4, 5, 9, 10, 33, 100):
        found = np.unique(np.concatenate([common[: n // 3], rng.integers(1, 1 << 62, n).astype(np.uint64)]))
        need = 0 if not len(found) else len(found) - -(-80 * len(found) // 100) + 1
        want = sorted(map(int, found), key=lambda x: (x in rank, rank.get(x, x)))[:need]
        assert list(map(int, jaccard_tree.front_of(found, common))) == want
        assert list(map(int, jaccard_tree.front_of(found))) == sorted(map(int, found))[:need]


def test_a_pair_of_several_trees_leaves_the_first_one_only():
    hashes = WordHashes()
    sets = [shingle_set(words_of(edited(prose(1, 80), k, 0.01)), hashes) for k in range(4)]
    rows = [
        {"key": key, "branch": branch, "rep": k, "root": k, "n_shingles": len(s), "bits": jaccard_tree.bitmap(s).tobytes(), "other": True, "earlier": [t for t in (5, 6, 7) if t < key]}
        for key, branch in ((5, 0), (6, 0), (7, 1))
        for k, s in enumerate(sets)
    ]
    table = pa.Table.from_pylist(rows)
    whole = [p for b in (0, 1) for p in jaccard_tree._candidates(table.filter(pc.equal(table["branch"], b))).to_pylist()]
    pairs = {(p["a"], p["b"]) for p in whole}
    assert pairs and len(pairs) == len(whole)
    # without what comes before, each tree gives its own
    alone = [r | {"earlier": []} for r in rows]
    assert len(jaccard_tree._candidates(pa.Table.from_pylist(alone[:8])).to_pylist()) == 2 * len(pairs)
