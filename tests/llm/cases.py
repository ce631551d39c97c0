"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the of and river stone walks slowly under bright winter moon when people gather near old wooden bridge singing songs about distant lands lost time".split()
CLASH = ["row", "key", "rep", "n", "size", "kept", "a", "b", "u", "h", "shard", "slot", "root", "target", "words", "_bucket", "score", "place"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "ing", str(rng.randrange(9))]) for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randrange(999)}" for w in text.split())


def rows():
    base = [prose(k, 30 + 13 * (k % 7)) for k in range(12)]
    out = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(base)]
    out += [(100 + k, t.upper(), None, None) for k, t in enumerate(base[:4])]
    out += [(200 + k, edited(base[4], k, 0.03), "de", "s0") for k in range(8)]
    out += [(300 + k, edited(base[5], k, 0.2), "de", "s1") for k in range(6)]
    out += [(400, None, "en", "s0"), (401, "", "en", "s1"), (402, " \n\t ", None, "s2"), (403, "one two", "en", "s0"), (404, "ONE two", "en", "s0"), (405, "1234 !!", "en", "s0"), (406, prose(77, 9000), "fr", "s2")]
    out += [(None, base[0], "en", "s0"), (None, None, None, None), (None, "alone here in the text", "en", "s1")]
    out += [(0, base[0], "en", "s0"), (401, "", "en", "s1")]
    return out


def documents(spark, data=None, clash=True):
    df = spark.createDataFrame(rows() if data is None else data, "doc_id long, text string, lang string, source string")
    if clash:
        for k, name in enumerate(CLASH):
            df = df.selectExpr("*", f"'{name}' as `{name}`" if k % 2 else f"{k} as `{name}`")
    return df


def shaped(documents):
    """With n_chars, as the table documents has it."""
    return documents.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")
