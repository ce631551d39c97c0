"""DuckDB SQL for the contract queries that SQL can express.

The others rest on a trained model (op1, op4, op5), a tokenizer (op6) or hashes that DuckDB lacks
(op7, op10); tests/llm holds them against brute-force versions.
"""

from __future__ import annotations

from . import jaccard_tree, licenses, mixing
from .common import LOWER, UPPER
from .registry import URL_RULES

_WORD = r"[^\x20\x09-\x0D]+"


def _lower(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def _values(rows: list[tuple]) -> str:
    cell = lambda v: str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


URLS = f"""
WITH r(action, rule, rhost, rpath) AS (VALUES {_values([(a, x, x.partition('/')[0], '/' + x.partition('/')[2]) for a, x in URL_RULES])}),
u AS (SELECT page_id, row_number() OVER () AS row, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, row, coalesce({_lower("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT row, arg_max(rule, (length(rule), length(rhost))) AS rule, arg_max(action, (length(rule), length(rhost))) AS action
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM h LEFT JOIN m USING (row)
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc, reach) AS (SELECT a, b FROM e UNION SELECT c.doc, e.b FROM c JOIN e ON c.reach = e.a),
g AS (SELECT doc, min(reach) AS low FROM c GROUP BY doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, least(d.doc_id, coalesce(low, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.doc = d.doc_id
"""

_W = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
MIX = f"""
WITH z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM per),
q AS (SELECT *, [{_W}][place % {len(mixing.WEIGHTS)} + 1] AS weight, source_size * {float(mixing.MAX_EPOCHS)}::DOUBLE AS cap FROM k),
f AS (SELECT *, cap / weight AS fill FROM q),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM f WINDOW o AS (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT min_by(level, (fill, place)) AS level FROM v WHERE fill >= level),
t AS (SELECT source, source_size, place, CASE WHEN fill < v.level THEN cap ELSE least(cap, weight * b.level) END AS target FROM v CROSS JOIN b),
a AS (SELECT z.doc_id, z.size, source_size, place, target, sum(z.size) OVER (PARTITION BY place ORDER BY substring(md5(CAST(doc_id AS VARCHAR)), 1, 8), doc_id) AS upto FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, (epoch * source_size + upto - size / 2) / target AS finish FROM (SELECT *, unnest(range(0, {mixing.MAX_EPOCHS})) AS epoch FROM a WHERE size > 0)),
s AS (SELECT doc_id, sum(size) OVER (ORDER BY finish, place, epoch, doc_id) - size / 2 <= (SELECT sum(source_size) FROM per) AS inside FROM o),
n AS (SELECT doc_id, count(*) FILTER (inside) AS epochs FROM s GROUP BY doc_id)
SELECT a.doc_id, a.size::BIGINT AS size, source_size, target, (coalesce(epochs, 0) * a.size)::BIGINT AS taken FROM a LEFT JOIN n USING (doc_id)
"""

_TEMPLATES = [(k, label, base, phrase) for k, (phrase, label, base) in enumerate([*((*x, True) for x in licenses.BASE), *((*x, False) for x in licenses.TEMPLATES)])]
LICENSES = rf"""
WITH RECURSIVE ph(tid, label, base, phrase) AS (VALUES {_values(_TEMPLATES)}),
pw AS (SELECT *, string_split(phrase, ' ') AS w FROM ph),
tp AS (SELECT tid, label, base, len(w) - 1 AS n_pairs, t AS tpos, w[t + 1] AS a, w[t + 2] AS b FROM (SELECT *, unnest(range(0, len(w) - 1)) AS t FROM pw)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{licenses.TOKEN}') AS w FROM documents),
g AS (SELECT row, p AS pos, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT row, w, unnest(range(0, len(w) - 1)) AS p FROM d)),
x AS (SELECT row, tid, label, base, n_pairs, pos, tpos, pos - tpos AS diagonal FROM g JOIN tp USING (a, b)),
v AS (SELECT row, tid, base, diagonal, min(pos) AS first, max(pos) AS last FROM x GROUP BY ALL),
m AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER o > {licenses.SHIFT} OR first - lag(last) OVER o > {licenses.SHIFT} + 1 OR lag(first) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY row, tid ORDER BY diagonal)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY row, tid ORDER BY diagonal) AS span FROM m),
f AS (SELECT x.row, x.tid, x.label, x.base, n_pairs, span, tpos, min(pos) AS pos FROM x JOIN s USING (row, tid, diagonal) GROUP BY ALL),
q AS (SELECT row, tid, label, base, n_pairs, span, count(*) AS n, min(pos) AS first_word FROM f GROUP BY ALL),
h(row, tid, span, tpos, pos, len) AS (SELECT row, tid, span, tpos, pos, 1 FROM f SEMI JOIN (FROM q WHERE n >= n_pairs * {licenses.COVERAGE}) USING (row, tid, span)
      UNION SELECT f.row, f.tid, f.span, f.tpos, f.pos, len + 1 FROM h JOIN f ON f.row = h.row AND f.tid = h.tid AND f.span = h.span AND f.tpos > h.tpos AND f.pos > h.pos),
y AS (SELECT row, tid, span, max(len) AS len FROM h GROUP BY ALL),
c AS (SELECT row, label, base, first_word, coalesce(len, n) / n_pairs AS coverage FROM q LEFT JOIN y USING (row, tid, span)),
k AS (SELECT row, count(*) FILTER (base AND coverage >= 1) AS n_base, min(first_word) FILTER (base AND coverage >= 1) AS first_word, max(first_word) FILTER (base AND coverage >= 1) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND coverage >= 1) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((base AND coverage >= 1) OR (NOT base AND coverage >= {licenses.COVERAGE})) AS labels,
      max(coverage) FILTER ((base AND coverage >= 1) OR (NOT base AND coverage >= {licenses.COVERAGE})) AS score FROM c GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN k USING (row)
"""

SQL: dict[str, str] = {"op2_url_filters": URLS, "op3_minhash_near_dedup": NEAR, "op8_mixing": MIX, "op9_license_scans": LICENSES}

_CRC = (
    "xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS UBIGINT)), "
    "lambda c, b: list_reduce(list_transform(range(8), lambda k: CAST(k AS UBIGINT)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(c, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"
)
_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{t}")) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _levels(name: str, rows: str, group: str) -> str:
    """Nodes of all levels of the trees of rows (group, place, n, digest), runs of eight."""
    return f"{name}(g, level, place, n, digest) AS (SELECT {group}, 0, place, n, digest FROM {rows} UNION ALL SELECT g, level + 1, place // 8, max((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY g, level, place // 8)"


def _beside(nodes: str, rows: str) -> str:
    """The siblings of each of rows (id, g, place), level by level, as one text."""
    return f"SELECT r.id, string_agg(u.digest, '' ORDER BY u.level, u.place) AS told FROM {rows} r JOIN {nodes} u ON u.g = r.g AND u.n > 1 AND u.place // 8 = r.place >> (3 * (u.level + 1)) AND u.place <> r.place >> (3 * u.level) GROUP BY r.id"


def _fold(name: str, nodes: str, rows: str) -> str:
    """What a digest d of each of rows (id, g, place, d) gives, level by level."""
    return (
        f"{name}(id, g, place, level, d) AS (SELECT id, g, place, 0, d FROM {rows} UNION ALL SELECT f.id, f.g, f.place, f.level + 1, sha256(string_agg(CASE WHEN u.place = f.place >> (3 * f.level) THEN f.d ELSE u.digest END, '' ORDER BY u.place)) "
        f"FROM {name} f JOIN {nodes} u ON u.g = f.g AND u.level = f.level AND u.n > 1 AND u.place // 8 = f.place >> (3 * (f.level + 1)) GROUP BY f.id, f.g, f.place, f.level)"
    )


SQL["op12_merkle_manifest"] = (
    f"WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(t='text')} AS digest, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(t=_LOWER)} ELSE {_LEAF.format(t='text')} END AS d FROM documents), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM d), "
    f"{_levels('up', 'l', 'g')}, tops AS (SELECT g AS lang, '' AS g, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n, digest FROM up WHERE n = 1), {_levels('over', 'tops', 'g')}, "
    f"root AS (SELECT digest FROM over WHERE n = 1), {_fold('fold', 'up', 'l')}, folded AS (SELECT id, arg_max(d, level) AS d FROM fold GROUP BY id), "
    "l2 AS (SELECT l.id, '' AS g, t.place, f.d FROM l JOIN tops t ON t.lang = l.g JOIN folded f ON f.id = l.id), "
    f"{_fold('fold2', 'over', 'l2')}, folded2 AS (SELECT id, arg_max(d, level) AS d FROM fold2 GROUP BY id), b1 AS ({_beside('up', 'l')}), b2 AS ({_beside('over', 'l2')}) "
    "SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, root.digest AS root, sha256(coalesce(b1.told, '') || coalesce(b2.told, '')) AS proof_sha256, f.d AS folded_root, f.d = root.digest AS verified "
    "FROM l JOIN tops t ON t.lang = l.g JOIN folded2 f ON f.id = l.id LEFT JOIN b1 ON b1.id = l.id LEFT JOIN b2 ON b2.id = l.id CROSS JOIN root"
)

# the join is the same as that of the near duplicates, at another threshold and without the choice
SQL["op13_ngram_jaccard"] = "SELECT doc_id, n_shingles, component_id FROM (" + NEAR.replace(">= 75 *", f">= {jaccard_tree.THRESHOLD} *") + ")"
