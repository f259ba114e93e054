"""SQL for the queries of this subpackage that SQL can express, by plain definitions."""

from __future__ import annotations

from .license_texts import PHRASES, TEMPLATES
from .licenses import parse
from .secrets import BASE, RULES

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

DECONTAMINATE = f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda s: array_to_string(w[s:s + k - 1], ' ')))) AS h
  FROM (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0)),
size AS (SELECT item_id, count(*) AS n FROM items GROUP BY 1),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
held AS (SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda s: array_to_string(w[s:s + k - 1], ' ')))) AS h
  FROM d, (SELECT DISTINCT k FROM items))
SELECT doc_id, item_id, n::INT AS item_shingles, count(*)::INT AS hits, round(count(*) / n, 6) AS containment
FROM held JOIN items USING (k, h) JOIN size USING (item_id) GROUP BY doc_id, item_id, n HAVING 4 * count(*) >= 3 * n"""


def _secrets() -> str:
    parts, pick = [], []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"""m{k} AS (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 0)) AS a, unnest(regexp_extract_all(text, '{p}', {r.group})) AS g,
  unnest(string_split_regex(text, '{p}')[:len(regexp_extract_all(text, '{p}', 0))]) AS gap, unnest(range(len(regexp_extract_all(text, '{p}', 0)))) AS n FROM t WHERE regexp_matches(text, '{p}')),
s{k} AS (SELECT doc_id, g, (sum(length(gap)) OVER w + sum(length(a)) OVER w - length(a))::BIGINT AS b, (sum(length(gap)) OVER w + sum(length(a)) OVER w)::BIGINT AS e FROM m{k} WINDOW w AS (PARTITION BY doc_id ORDER BY n))"""
        )
        pick.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, b, e FROM s{k} WHERE length(g) >= {r.least}")
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    text = "concat_ws(':', kind, b, e)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(parts)},
spans AS ({" UNION ALL ".join(pick)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY b, k) FILTER (k < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' ORDER BY b, k) FILTER (k IS NOT NULL), '') AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


NEAR_DUP = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda s: array_to_string(w[s:s + 4], ' '))) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n m ON m.doc_id = a.doc_id JOIN n o ON o.doc_id = b.doc_id
  GROUP BY 1, 2, m.n, o.n HAVING 100 * count(*) >= 75 * (m.n + o.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

MERKLE = """WITH RECURSIVE bytes AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
f AS (SELECT doc_id, source, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS v, text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS bad FROM documents, bytes),
e AS (SELECT *, array_to_string(list_transform(v, lambda x: coalesce(strlen(x) || ':' || x, '-')), '') AS head, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM f),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN bad THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
t(s, k, i, h, n) AS (SELECT source, 0, i, leaf, n FROM p UNION ALL
  SELECT s, k + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY s, k, i // 16, n),
r AS (SELECT s, k, i // 16 AS j, list(h ORDER BY i) AS run FROM t WHERE n > 1 GROUP BY 1, 2, 3),
b AS (SELECT s, h, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(k, i, h, n) AS (SELECT 0, i, h, n FROM b UNION ALL SELECT k + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY k, i // 16, n),
q AS (SELECT k, i // 16 AS j, list(h ORDER BY i) AS run FROM u WHERE n > 1 GROUP BY 1, 2),
steps AS (SELECT p.source, p.i, 0 AS tree, r.k, run, (p.i // (16 ** r.k)::BIGINT) % 16 AS a FROM p JOIN r ON r.s IS NOT DISTINCT FROM p.source AND r.j = p.i // (16 ** (r.k + 1))::BIGINT
  UNION ALL SELECT p.source, p.i, 1, q.k, run, (b.i // (16 ** q.k)::BIGINT) % 16 FROM p JOIN b ON b.s IS NOT DISTINCT FROM p.source JOIN q ON q.j = b.i // (16 ** (q.k + 1))::BIGINT),
proofs AS (SELECT source, i, string_agg(array_to_string(run[:a], '') || array_to_string(run[a + 2:], ''), '' ORDER BY tree, k) AS siblings, list(array_to_string(run[:a], '') || ',' || array_to_string(run[a + 2:], '') ORDER BY tree, k) AS steps FROM steps GROUP BY 1, 2),
o AS (SELECT doc_id, leaf, b.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(changed, leaf), coalesce(steps, [])), lambda h, x: sha256(split_part(x, ',', 1) || h || split_part(x, ',', 2))) AS folded_root
  FROM p JOIN b ON b.s IS NOT DISTINCT FROM p.source LEFT JOIN proofs ON proofs.source IS NOT DISTINCT FROM p.source AND proofs.i = p.i)
SELECT *, folded_root = root AS verified FROM o"""


def _as_regex(items: list) -> str:
    """A template as a regex over words with a space after each."""
    part = lambda x: f"{x} " if isinstance(x, str) else f"(?:[^ ]+ ){{{x[0]},{x[1]}}}" if isinstance(x, tuple) else f"(?:{_as_regex(x)})?"
    return "".join(map(part, items))


def _licenses() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    places = [f"list_transform(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()}), lambda i: {{'label': '{label}', 'start': i}})" for p, label in PHRASES]
    found = [f"CASE WHEN regexp_matches(t, ' {_as_regex(parse(p))}') THEN [{{'label': '{label}', 'words': {sum(isinstance(x, str) for x in parse(p))}}}] ELSE [] END" for label, p in (*((label, p) for p, label in PHRASES), *TEMPLATES)]
    labels = "array_to_string(list_sort(list_distinct(list_transform({}, lambda s: s.label))), ',')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), j AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
m AS (SELECT doc_id, len(w) AS n_words, {" || ".join(places)} AS base, {" || ".join(found)} AS hits FROM j),
s AS (SELECT *, coalesce(list_max(list_transform(hits, lambda h: h.words)), 0) AS most FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, len(base)::BIGINT AS n_base, list_min(list_transform(base, lambda s: s.start))::BIGINT AS first_word, list_max(list_transform(base, lambda s: s.start))::BIGINT AS last_word,
  {labels.format("base")} AS base_labels, {labels.format("hits")} AS labels, most / (most + 1) AS score FROM s"""


ORACLE: dict[str, str] = {
    "op1_decontaminate": DECONTAMINATE,
    "op2_secrets": _secrets(),
    "op7_near_dup": NEAR_DUP,
    "op10_topk": TOP_K,
    "op11_manifest": MERKLE,
    "op12_licenses": _licenses(),
}
