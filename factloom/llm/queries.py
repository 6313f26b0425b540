"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from factloom.llm import license_join
from factloom.llm.additive_quality import op12_additive_quality
from factloom.llm.bpe_queue import op3_bpe_queue
from factloom.llm.hmm_scoring import op1_hmm_scoring
from factloom.llm.hyperminhash import op8_hyperminhash
from factloom.llm.lanczos_whitening import op13_lanczos_whitening
from factloom.llm.language_segments import op9_language_segments
from factloom.llm.license_join import op4_license_join
from factloom.llm.metric_join import op10_metric_join
from factloom.llm.multi_index_hashing import op7_multi_index_hashing
from factloom.llm.packing import op5_packing
from factloom.llm.secret_crf import op2_secret_crf
from factloom.llm.toxicity_ordinal import op6_toxicity_ordinal
from factloom.llm.wavelet_ranking import op11_wavelet_ranking

QUERIES = {
    f.__name__: f
    for f in (
        op1_hmm_scoring,
        op2_secret_crf,
        op3_bpe_queue,
        op4_license_join,
        op5_packing,
        op6_toxicity_ordinal,
        op7_multi_index_hashing,
        op8_hyperminhash,
        op9_language_segments,
        op10_metric_join,
        op11_wavelet_ranking,
        op12_additive_quality,
        op13_lanczos_whitening,
    )
}

UPPER, LOWER = license_join.UPPER, license_join.LOWER
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TEMPLATES = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {license_join.need(len(set(t.split())), 0.92)})" for label, t in license_join.TEMPLATES)
_PHRASES = ", ".join(f"('{label}', {p.split()!r})" for p, label in license_join.PHRASES.items())

ORACLE_SQL: dict[str, str] = {
    "op4_license_join": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '{_WORDS}') AS ws FROM d),
ph(label, p) AS (VALUES {_PHRASES}), tpl(label, t, need) AS (VALUES {_TEMPLATES}),
hit AS (SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: list_slice(ws, i + 1, i + len(p)) = p)) AS place FROM w JOIN ph ON contains(low, p[1])),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM hit GROUP BY doc_id),
line AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), '{_WORDS}')) AS ws FROM d),
found AS (SELECT doc_id, label, len(list_intersect(ws, t)) / len(t) AS c FROM line JOIN tpl ON len(ws) >= need AND len(list_intersect(ws, t)) >= need),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hit GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hit UNION SELECT doc_id, label FROM found) x GROUP BY doc_id),
sc AS (SELECT doc_id, max(c) AS score FROM found GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)""",
    "op8_hyperminhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss FROM w),
x AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
c(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, c.label FROM c JOIN p ON p.a = c.node),
m AS (SELECT node, min(label) AS label FROM c GROUP BY node)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, label AS component_id, label = doc_id AS kept FROM s JOIN m ON node = doc_id""",
    "op10_metric_join": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS r FROM v WHERE list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.9),
c(node, label) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, c.label FROM c JOIN p ON p.a = c.node),
k AS (SELECT a, count(*) AS n FROM p GROUP BY a), m AS (SELECT node, min(label) AS label FROM c GROUP BY node)
SELECT vec_id, coalesce(k.n, 0) AS n_links, m.label AS component_id, m.label = vec_id AS kept FROM embeddings JOIN m ON node = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op11_wavelet_ranking": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERMS}') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERMS}')) AS t FROM benchmark) x GROUP BY item_id, t),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) x WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t) x, s),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ws) * n) // l AS m FROM d, s WHERE len(ws) > 0),
z AS (SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM z JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
}
