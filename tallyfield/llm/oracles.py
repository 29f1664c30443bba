"""SQL for the training-data queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from tallyfield.llm import divergence

_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents)"

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) payload_bytes, sha1(b) payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN keeper <> page_id THEN keeper END refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') x FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= 0.8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT doc_id, min(reached) class_id FROM r GROUP BY doc_id
"""

SUBSTRINGS = rf"""
WITH {_WORDS},
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') k FROM w, unnest(range(1, len(ws) - 18)) t(i)),
f AS (SELECT k, min({{'d': doc_id, 'i': i}}) first FROM x GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) j FROM x JOIN f USING (k) WHERE first.d <> doc_id OR first.i <> i),
o AS (SELECT doc_id, unnest(ws) word, generate_subscripts(ws, 1) j FROM w),
q AS (SELECT o.doc_id, count(*) n, count(g.j) gone, coalesce(string_agg(CASE WHEN g.j IS NULL THEN word END, ' ' ORDER BY o.j), '') kept FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.j = g.j GROUP BY o.doc_id)
SELECT w.doc_id, coalesce(n, 0) n_words, coalesce(gone, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN q ON w.doc_id = q.doc_id
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) i FROM s)
SELECT query_id, CAST(i AS INT) AS rank, vec_id, score FROM r WHERE i <= 10
"""


#: Jensen-Shannon distance of the pairs in a list; null where the list is null.
_DISTANCE = "sqrt(greatest(0, list_sum(list_transform({z}, lambda y: CASE WHEN y[1] > 0 THEN y[1] * log2(2 * y[1] / (y[1] + y[2])) ELSE 0 END + CASE WHEN y[2] > 0 THEN y[2] * log2(2 * y[2] / (y[1] + y[2])) ELSE 0 END)) / 2))"

_COMMON = "MAP {" + ", ".join(f"'{k}': {ws}" for k, ws in divergence.COMMON_WORDS.items()) + "}"

DIVERGENCE = rf"""
WITH {_WORDS},
d AS (SELECT doc_id, lang, coalesce(text, '') t, {_COMMON}[lang] l, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') runs FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') k FROM w, unnest(range(1, len(ws) - 1)) t(i)),
r AS (SELECT doc_id, count(DISTINCT j) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) c FROM x) WHERE c > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, len(ws) n_words, len(array_to_string(ws, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
        len(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')))) n_dup_lines,
        coalesce(r.n, 0) n_repeat_words, runs, l,
        len(regexp_extract_all(t, '\p{{Ll}}')) a, len(regexp_extract_all(t, '\p{{Lu}}')) b, len(regexp_extract_all(t, '\p{{L}}')) letters, len(regexp_extract_all(t, '\p{{N}}+')) numbers,
        len(regexp_extract_all(t, '\p{{N}}')) digits, len(regexp_extract_all(t, '[\x20\x09-\x0D]')) space, len(t) n
      FROM d JOIN w USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {divergence.LEAST_WORDS} OR 100 * n_repeat_words > {divergence.MOST_REPEATED} * n_words base_failed,
        [a, b, letters - a - b, numbers, space, n_symbols, n - letters - digits - space - n_symbols] classes, len(runs) n_runs,
        CASE WHEN l IS NOT NULL THEN list_append(list_transform(l, lambda x: len(list_filter(runs, lambda y: y = x))), len(list_filter(runs, lambda y: NOT list_contains(l, y)))) END common FROM c),
s AS (SELECT lang, unnest(list_transform(classes, lambda x: floor(1000 * x / list_sum(classes)))) v, generate_subscripts(classes, 1) i FROM f WHERE NOT base_failed),
m AS (SELECT lang, i, quantile_cont(v, 0.5) q, count(*) n FROM s GROUP BY lang, i),
u AS (SELECT lang, list(q ORDER BY i) q FROM m WHERE lang IS NOT NULL AND n >= {divergence.LEAST_DOCUMENTS} GROUP BY lang),
p AS (SELECT list(q ORDER BY i) q FROM (SELECT i, quantile_cont(v, 0.5) q FROM s GROUP BY i)),
sw AS (SELECT lang, unnest(list_transform(common, lambda x: floor(1000 * x / n_runs))) v, generate_subscripts(common, 1) i FROM f WHERE NOT base_failed AND n_runs >= {divergence.LEAST_RUNS} AND common IS NOT NULL),
uw AS (SELECT lang, list(q ORDER BY i) q FROM (SELECT lang, i, quantile_cont(v, 0.5) q FROM sw GROUP BY lang, i) WHERE lang IN (SELECT lang FROM u) GROUP BY lang),
h AS (SELECT f.*, list_zip(list_transform(classes, lambda x: x / list_sum(classes)), list_transform(coalesce(u.q, p.q), lambda x: x / list_sum(coalesce(u.q, p.q)))) zc,
        CASE WHEN n_runs >= {divergence.LEAST_RUNS} THEN list_zip(list_transform(common, lambda x: x / n_runs), list_transform(uw.q, lambda x: x / list_sum(uw.q))) END zw
      FROM f LEFT JOIN u ON f.lang = u.lang LEFT JOIN uw ON f.lang = uw.lang CROSS JOIN p),
j AS (SELECT *, {_DISTANCE.format(z="zc")} dc, {_DISTANCE.format(z="zw")} dw FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(dc <= {divergence.MOST_CLASS_DISTANCE}, true) AND coalesce(dw <= {divergence.MOST_WORD_DISTANCE}, true) kept FROM j
"""

_VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _assigned(round_: int) -> str:
    """One round of assignment and averaging."""
    apart = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""
a{round_} AS (SELECT id, part, min({{'d': {apart}, 'e': entry}}) best FROM p JOIN c{round_} c USING (part) GROUP BY id, part),
s{round_} AS (SELECT part, best.e entry, k, CAST(floor(sum(x[k]) / count(*)) AS BIGINT) v FROM a{round_} JOIN p USING (id, part), unnest(range(1, len(x) + 1)) t(k) GROUP BY ALL),
n{round_} AS (SELECT part, entry, list(v ORDER BY k) y FROM s{round_} GROUP BY part, entry),
c{round_ + 1} AS (SELECT part, entry, coalesce(y, x) x FROM c{round_} LEFT JOIN n{round_} USING (part, entry))"""


CODES = f"""
WITH v AS (SELECT row_number() OVER () id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings WHERE {_VALID}),
p AS (SELECT id, vec_id, s part, q[s * len(q) // 16 + 1:(s + 1) * len(q) // 16] x FROM v, range(16) t(s)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 entry, x FROM p QUALIFY entry < 64),
{_assigned(0)}, {_assigned(1)},
{_assigned(2).split("s2 AS")[0].rstrip().rstrip(",")},
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) codebooks_sha256 FROM c2),
e AS (SELECT id, string_agg(printf('%02x', best.e), '' ORDER BY part) code, CAST(sum(best.d) AS BIGINT) error FROM a2 GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, codebooks_sha256 FROM e JOIN v USING (id) CROSS JOIN b
"""

HARD_NEGATIVES = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings WHERE label IS NOT NULL AND {_VALID}),
s AS (SELECT a.vec_id anchor_id, b.vec_id, a.label = b.label same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id negative_id, s.score negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) i FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(i AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE i <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC, "op8_minhash_dedup": NEAR_DUPLICATES, "op9_substring_dedup": SUBSTRINGS, "op10_voronoi_topk": TOP_K, "op11_divergence_rules": DIVERGENCE, "op12_vector_codes": CODES, "op13_hard_negatives": HARD_NEGATIVES}
