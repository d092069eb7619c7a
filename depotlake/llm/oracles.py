"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from depotlake.llm import secrets
from depotlake.llm.embeddings import THRESHOLD as COSINE
from depotlake.llm.jaccard import THRESHOLD, WORDS


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def found(kind: int, pattern: str, group: int, keep: str) -> str:
    p = quoted(pattern)
    return f"""SELECT doc_id, {kind} AS kind, i, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits FROM (SELECT doc_id, t, UNNEST(range(1, len(regexp_extract_all(t, {p})) + 1)) AS i, regexp_extract_all(t, {p}, {group}) AS g FROM d) x WHERE {keep}"""


SIZES = lambda part: f"COALESCE(list_sum(list_transform({part}, lambda s: length(s))), 0)"
NAMES = "[" + ", ".join(quoted(k) for k in secrets.KINDS) + "]"
NEAR = f"(x.e <= p.s AND p.s - x.e <= {secrets.SCOPE} OR x.s >= p.e AND x.s - p.e <= {secrets.SCOPE})"
SPANS = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join([found(0, secrets.ASSIGN, 2, f'length(g[i]) >= {secrets.LEAST}'), found(1, secrets.ACCESS, 0, 'TRUE'), found(2, secrets.HEX, 0, 'TRUE'), found(3, secrets.SECRET, 0, f'length(g[i]) = {secrets.SECRET_LENGTH}'), found(4, secrets.ENDPOINT, 0, 'TRUE')])}),
p AS (SELECT doc_id, kind, CAST(s AS BIGINT) AS s, CAST(s + length(hits[i]) AS BIGINT) AS e FROM (SELECT *, {SIZES('gaps[1:i]')} + {SIZES('hits[1:i-1]')} AS s FROM hits) h),
a AS (SELECT * FROM p WHERE kind = 1),
q AS (SELECT *, EXISTS (SELECT 1 FROM a x WHERE x.doc_id = p.doc_id AND x.s < p.e AND x.e > p.s) AS in_access FROM p),
kept AS (SELECT * FROM q p WHERE kind <= 2 OR NOT in_access AND EXISTS (SELECT 1 FROM a x WHERE x.doc_id = p.doc_id AND {NEAR}) AND (kind = 3 OR EXISTS (SELECT 1 FROM q x WHERE x.doc_id = p.doc_id AND x.kind IN (0, 3) AND NOT x.in_access AND {NEAR}))),
named AS (SELECT *, ({NAMES})[kind + 1] || ':' || s || ':' || e AS name FROM kept)
SELECT d.doc_id, COUNT(CASE WHEN kind = 0 THEN 1 END) AS n_assign, COUNT(CASE WHEN kind = 1 THEN 1 END) AS n_access, COUNT(CASE WHEN kind = 2 THEN 1 END) AS n_hex,
sha256(COALESCE(string_agg(CASE WHEN kind <= 2 THEN name END, ',' ORDER BY s, kind), '')) AS base_sha256, COALESCE(string_agg(name, ',' ORDER BY s, kind), '') AS spans, COUNT(CASE WHEN kind > 2 THEN 1 END) AS n_linked
FROM d LEFT JOIN named ON named.doc_id = d.doc_id GROUP BY d.doc_id"""

#: Rows of (a, b) in links give, for each id, its number of links and the smallest id it reaches.
REACH = "reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda s: s <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, UNNEST(s) AS g FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING COUNT(*) >= {THRESHOLD} * (x.n + y.n - COUNT(*)) - 1e-9), {REACH}
SELECT s.doc_id, CASE WHEN len(s) > 0 THEN MIN(s.doc_id) OVER (PARTITION BY s) ELSE s.doc_id END AS class_id, COALESCE(n, 0) AS n_links, LEAST(s.doc_id, COALESCE(m, s.doc_id)) AS component_id, s.doc_id = LEAST(s.doc_id, COALESCE(m, s.doc_id)) AS kept
FROM s LEFT JOIN (SELECT a, COUNT(*) AS n FROM links GROUP BY 1) c ON c.a = s.doc_id LEFT JOIN (SELECT a, MIN(b) AS m FROM reach GROUP BY 1) r ON r.a = s.doc_id"""
COSINES = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM v WHERE v IS NOT NULL AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= {COSINE}), {REACH}
SELECT v.vec_id, COALESCE(n, 0) AS n_links, LEAST(v.vec_id, COALESCE(m, v.vec_id)) AS component_id, v.vec_id = LEAST(v.vec_id, COALESCE(m, v.vec_id)) AS kept, MIN(v.vec_id) OVER (PARTITION BY v.v) AS class_id
FROM v LEFT JOIN (SELECT a, COUNT(*) AS n FROM links GROUP BY 1) c ON c.a = v.vec_id LEFT JOIN (SELECT a, MIN(b) AS m FROM reach GROUP BY 1) r ON r.a = v.vec_id"""



def field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def tree(name: str, leaves: str) -> str:
    """Nodes of trees of runs of three, level by level; n is the number of nodes of the level. leaves: tree, pos, digest, n."""
    return f"""{name} AS (SELECT tree, 0 AS level, pos, digest, n FROM ({leaves}) l
    UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, n, pos // 3)"""


def steps(nodes: str, rows: str, first: str) -> str:
    """For each row (id, tree, pos) and level: the digests left and right of its node in their run."""
    own = "(r.pos // CAST(POWER(3, g.level) AS BIGINT))"
    return f"""SELECT r.id, {first} + g.level AS step, COALESCE(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < {own}), '') AS l, COALESCE(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > {own}), '') AS r
    FROM ({rows}) r JOIN (SELECT DISTINCT tree, level FROM {nodes} WHERE n > 1) g ON g.tree IS NOT DISTINCT FROM r.tree
    LEFT JOIN {nodes} x ON x.tree IS NOT DISTINCT FROM r.tree AND x.level = g.level AND x.pos // 3 = {own} // 3 AND x.pos <> {own} GROUP BY r.id, r.pos, g.level"""


#: The last bit of the CRC-32 of a decimal number's text.
ODD = """(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) & 1) = 0"""
MERKLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, text, {' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} AS head, CASE WHEN doc_id IS NOT NULL AND NOT {ODD} THEN replace(text, chr(10), '') ELSE text END AS hurt FROM documents),
leaves AS (SELECT doc_id, source AS tree, sha256(head || {field('text')}) AS leaf, sha256(head || {field('hurt')}) AS shown FROM d),
placed AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id, leaf) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, COUNT(*) OVER (PARTITION BY tree) AS n FROM leaves),
{tree('low', 'SELECT tree, pos, leaf AS digest, n FROM placed')},
subs AS (SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, COUNT(*) OVER () AS n FROM low WHERE n = 1),
{tree('high', "SELECT '' AS tree, pos, subroot AS digest, n FROM subs")},
ways AS ({steps('low', 'SELECT id, tree, pos FROM placed', '0')} UNION ALL {steps('high', "SELECT p.id, '' AS tree, s.pos FROM placed p JOIN subs s ON s.source IS NOT DISTINCT FROM p.tree", '100')}),
way AS (SELECT id, l, r, row_number() OVER (PARTITION BY id ORDER BY step) AS step FROM ways),
folded AS (SELECT id, CAST(0 AS BIGINT) AS step, shown AS digest FROM placed UNION ALL SELECT f.id, w.step, sha256(w.l || f.digest || w.r) FROM folded f JOIN way w ON w.id = f.id AND w.step = f.step + 1),
ends AS (SELECT id, arg_max(digest, step) AS folded_root FROM folded GROUP BY 1),
proofs AS (SELECT p.id, sha256(COALESCE(string_agg(w.l || w.r, '' ORDER BY w.step), '')) AS proof_sha256 FROM placed p LEFT JOIN way w ON w.id = p.id GROUP BY 1),
top AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, top.root, proofs.proof_sha256, ends.folded_root, ends.folded_root = top.root AS verified
FROM placed p JOIN subs s ON s.source IS NOT DISTINCT FROM p.tree JOIN proofs ON proofs.id = p.id JOIN ends ON ends.id = p.id CROSS JOIN top"""

ORACLES = {"op13_merkle_manifest": MERKLE, "op2_bayesian_jaccard_join": JACCARD, "op4_credential_linking": SPANS, "op6_inverted_multi_index": COSINES}
