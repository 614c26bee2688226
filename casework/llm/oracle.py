"""The corpus operators in plain SQL, where SQL can express them."""

from __future__ import annotations

#: One space for each run of ASCII white space.
NORMALISED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

OP4 = f"""
WITH d AS (SELECT doc_id, sha256({NORMALISED}) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


#: Non-empty words of a text, A-Z in lower case.
LOWER_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x20\x09-\x0D]+'), lambda x: x <> '')"
)

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS ws FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
    FROM w
),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (total - shared)),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(other) FROM r WHERE r.id = s.doc_id) AS component_id FROM s
"""


OP5 = r"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents
),
b AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, ws
    FROM w
),
i AS (SELECT doc_id, unnest(range(1, n_words + 1)) AS i, ws FROM b),
g AS (
    SELECT doc_id, i, length(ws[i]) AS chars,
        CASE WHEN i + 4 <= len(ws) THEN count(*) OVER (PARTITION BY doc_id, i + 4 <= len(ws), ws[i:i + 4]) ELSE 0 END AS n5,
        CASE WHEN i + 64 <= len(ws) THEN count(*) OVER (PARTITION BY doc_id, i + 64 <= len(ws), hash(ws[i:i + 64])) ELSE 0 END AS n65
    FROM i
),
c AS (SELECT *, max(n5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 1 AS again FROM g),
r AS (SELECT doc_id, count_if(again) AS n, sum(CASE WHEN again THEN chars ELSE 0 END) AS chars, max(n65) > 1 AS long FROM c GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words OR 100 * coalesce(r.chars, 0) > 25 * word_chars OR coalesce(long, false)) AS kept
FROM b LEFT JOIN r USING (doc_id)
"""


OP8 = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
k AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS key FROM l),
s AS (SELECT key FROM k WHERE key <> '' AND source IS NOT NULL GROUP BY key HAVING count(DISTINCT source) >= 5),
m AS (SELECT k.doc_id, k.i, k.line, s.key IS NULL AS keep FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(NOT keep)::BIGINT AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS text_sha256
FROM m GROUP BY doc_id
"""

OP9 = """
WITH c AS (
    SELECT conv_id, turn, 'call_' || turn AS call_id, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'count' END AS name,
        CASE turn % 8 WHEN 5 THEN json_object('limit', 'many', 'text', text) WHEN 2 THEN json_object('limit', length(text))
            WHEN 4 THEN json_array(text) ELSE json_object('limit', length(text), 'text', text) END AS arguments,
        CASE WHEN turn > 2 AND turn % 8 > 2 THEN 'call_' || (turn - 2) END AS parent
    FROM conversations WHERE role = 'assistant'
),
r AS (SELECT conv_id, turn AS result_turn, 'call_' || (turn - 1) AS call_id, text AS result FROM conversations WHERE role = 'user' AND turn > 0),
e AS (SELECT c.*, p.call_id AS known FROM c LEFT JOIN (SELECT conv_id, call_id FROM c) p ON c.conv_id = p.conv_id AND c.parent = p.call_id),
v AS (
    SELECT *, (SELECT count(*) FROM e f WHERE f.conv_id = e.conv_id AND f.known IS NOT NULL AND f.turn <= e.turn AND f.turn // 8 = e.turn // 8
            AND f.turn % 2 = e.turn % 2) AS chain
    FROM e
),
a AS (
    SELECT conv_id, turn, call_id, name, CASE WHEN known IS NULL THEN 0 ELSE chain END AS level, result_turn,
        concat_ws(' ', CASE WHEN turn % 8 = 4 THEN 'not_an_object' WHEN name = 'search' AND turn % 8 = 5 THEN 'type:limit'
            WHEN name = 'search' AND turn % 8 = 2 THEN 'missing:text' WHEN name = 'lookup' AND turn % 8 = 5 THEN 'type:limit'
            WHEN name = 'lookup' AND turn % 8 = 2 THEN 'missing:text'
            WHEN name = 'count' AND turn % 8 = 2 THEN 'missing:text unexpected:limit' WHEN name = 'count' THEN 'unexpected:limit' END,
            CASE WHEN parent IS NOT NULL AND known IS NULL THEN 'unknown_reference' END) AS problems,
        CASE WHEN turn % 8 <> 4 THEN arguments END AS arguments, result
    FROM v LEFT JOIN r USING (conv_id, call_id)
    UNION ALL
    SELECT conv_id, result_turn, call_id, NULL, 0, result_turn, 'no_call', NULL, result FROM r ANTI JOIN c USING (conv_id, call_id)
)
SELECT conv_id, turn, call_id, name, CAST(level AS BIGINT) AS level, result_turn, problems,
    '{' || concat_ws(',', '"arguments":' || arguments::VARCHAR, '"id":' || to_json(call_id)::VARCHAR, '"name":' || to_json(name)::VARCHAR,
        '"result":' || to_json(result)::VARCHAR) || '}' AS json
FROM a
"""

_UUID = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'"
_ENTITIES = [("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&hellip;", "'…'"), ("&mdash;", "'—'"), ("&ndash;", "'–'"), ("&amp;", "'&'")]


def _resolved(text: str) -> str:
    for entity, character in _ENTITIES:
        text = f"replace({text}, '{entity}', {character})"
    return text


def _plain_text() -> str:
    hidden = "|".join(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "noscript", "head")) + "|<!--.*?-->"
    lines = "</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|blockquote|pre)\\b[^>]*>"
    text = f"regexp_replace(regexp_replace(payload, '{hidden}', ' ', 'gis'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{lines}', chr(10), 'gi'), '<[^>]*>', '', 'g')"
    text = _resolved(text)
    return f"regexp_replace(regexp_replace({text}, ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


OP10 = f"""
WITH p AS (SELECT url, coalesce(html, '') AS payload, '2024-01-01T00:00:00Z' AS date, chr(13) || chr(10) AS nl FROM pages),
q AS (SELECT *, strlen(payload) AS n, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(payload) AS http,
    sha256('response' || chr(10) || coalesce(url, '') || chr(10) || date || chr(10) || payload) AS h FROM p),
s AS (SELECT *, {_UUID} AS refers_to, 'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(http || nl || nl || payload) AS source_digest FROM q),
t AS (
    SELECT * EXCLUDE (h), 'metadata' AS record_type, 'application/warc-fields' AS content_type,
        concat_ws(nl, 'httpStatus: 200', 'sourceContentType: text/html; charset=utf-8',
            'title: ' || regexp_replace({_resolved("regexp_replace(regexp_extract(payload, '<title[^>]*>(.*?)</title', 1, 'is'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')")}, '[ \t\n\x0B\f\r]+', ' ', 'g'),
            'language: ' || regexp_extract(payload, '<html[^>]*\\blang=["'']?([A-Za-z-]+)', 1, 'is'),
            'outlinks: ' || len(regexp_extract_all(payload, '<a\\s[^>]*href=', 0, 'i')), 'sourcePayloadDigest: ' || payload_digest,
            'sourceHttpHeader: Content-Type: text/html; charset=utf-8', 'sourceHttpHeader: Content-Length: ' || strlen(payload)) AS block FROM s
    UNION ALL
    SELECT * EXCLUDE (h), 'conversion', 'text/plain; charset=utf-8', {_plain_text()} FROM s
),
u AS (SELECT *, sha256(record_type || chr(10) || refers_to) AS h, 'sha256:' || sha256(block) AS block_digest FROM t),
v AS (SELECT *, {_UUID} AS record_id FROM u)
SELECT record_id, record_type, refers_to, url AS target_uri, date, content_type, block, block_digest, payload_digest,
    concat_ws(nl, 'WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || record_id, 'WARC-Date: ' || date, 'WARC-Target-URI: ' || url,
        'WARC-Refers-To: ' || refers_to, 'WARC-Refers-To-Target-URI: ' || url, 'WARC-Refers-To-Date: ' || date, 'WARC-Block-Digest: ' || block_digest,
        'WARC-Source-Block-Digest: ' || source_digest, 'WARC-Source-Payload-Digest: ' || payload_digest, 'Content-Type: ' || content_type,
        'Content-Length: ' || strlen(block)) AS head
FROM v
"""


#: n-grams of 1 to 4 words within pieces, counted; cuts; and what lies in a longer one.
OP11 = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
    SELECT lang, m.m AS size, array_to_string(ws[i:i + m.m - 1], ' ') AS phrase, count(*) AS f
    FROM s, (SELECT unnest([1, 2, 3, 4]) AS m) m WHERE i + m.m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30
),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE size > 1),
k AS (SELECT lang, phrase, f AS a, unnest(range(1, size)) AS k, ws FROM c),
x AS (
    SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score
    FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')
),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, f, size, ws, unnest(range(2, size)) AS m FROM c WHERE size > 2),
v AS (SELECT lang, f, ws, m, unnest(range(1, size - m + 2)) AS i FROM u),
y AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM v GROUP BY ALL),
z AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
    FROM b LEFT JOIN y ON y.lang = b.lang AND y.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000
"""


def _op13(rounds: int = 10) -> str:
    """Every round is a table of centroids and one of the nearest centroid of each vector."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, x AS c FROM v ORDER BY j LIMIT 8)",
    ]
    nearest = """SELECT vec_id, x, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT vec_id, x, j,
        list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{}) GROUP BY vec_id, x"""
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.j, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (
            SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
                FROM (SELECT j, unnest(x) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY j, i) GROUP BY j) n ON n.j = o.j)""")
    last = rounds
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON a.j = c.j"""


def all_oracles() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": OP3, "op4_exact_dedup": OP4, "op5_quality_rules": OP5, "op8_line_dedup": OP8, "op9_chat_formatting": OP9, "op10_warc_derivatives": OP10, "op11_collocations": OP11, "op13_centroid_clustering": _op13()}
