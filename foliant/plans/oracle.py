"""The same queries in DuckDB SQL, written apart from the operators."""

from __future__ import annotations

from ..functions.words import COMMON_WORDS, STOPWORDS
from ..operators.router import BOOK_PATTERNS, OTHER_PATTERNS, QUESTION_WORDS
from .derived import in_duckdb
from .fixtures import FIXTURES

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS = """
tok AS (SELECT source AS book_id, doc_id AS chapter_id, generate_subscripts(t, 1) AS i, unnest(t) AS term
        FROM (SELECT source, doc_id, list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: lower(x)) AS t FROM documents)),
n AS (SELECT source AS book_id, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1)"""
KEEP = f"length(term) >= 3 AND term NOT IN ({STOP})"


def _scored(counts: str, keep: str, top: int) -> str:
    """keywords from counts(book_id, chapter_id, term, tf)"""
    return f"""{TOKENS}, {counts},
df AS (SELECT book_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT tf.book_id, chapter_id, tf.term, tf, df, tfidf, row_number() OVER (PARTITION BY tf.book_id, chapter_id ORDER BY tfidf DESC, term) AS rank
       FROM (SELECT tf.book_id, chapter_id, tf.term, tf, df, round(tf * ln(n / df), 6) AS tfidf FROM tf JOIN df USING (book_id, term) JOIN n USING (book_id) WHERE tf >= 2 AND {keep}) tf) WHERE rank <= {top})"""


UNI = "tf AS (SELECT book_id, chapter_id, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3)"
BI = f"""kept AS (SELECT book_id, chapter_id, i, term, lead(term) OVER (PARTITION BY book_id, chapter_id ORDER BY i) AS nxt FROM tok WHERE {KEEP}),
tf AS (SELECT book_id, chapter_id, term || ' ' || nxt AS term, count(*) AS tf FROM kept WHERE nxt IS NOT NULL GROUP BY 1, 2, 3)"""
KEYWORDS = _scored(UNI, KEEP.replace("term", "tf.term"), 50)
VOCAB = "vocab AS (SELECT * FROM (SELECT book_id, term, score, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, term) - 1 AS index FROM (SELECT book_id, term, round(sum(tfidf), 6) AS score FROM kw GROUP BY 1, 2)) WHERE index < 100)"
BLOCKS = "b AS (SELECT source AS book_id, doc_id AS chapter_id, generate_subscripts(l, 1) - 1 AS ordinal, unnest(l) AS text FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))"
COUNTS = "c AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS spine_index, CAST(greatest(1, ceil(n_chars / 500)) AS INT) AS pages, n_chars AS length FROM documents), s AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY book_id ORDER BY spine_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_page FROM c)"
ASKED = "asked AS (SELECT item_id AS query_id, lower(array_to_string(regexp_split_to_array(regexp_replace(coalesce(text, ''), '^ +| +$', '', 'g'), '\\s+')[1:2], ' ')) AS q FROM benchmark), hit AS (SELECT query_id, book_id, chapter_id, ordinal, instr(lower(text), q) - 1 AS match_pos FROM b JOIN asked ON length(q) > 0 AND contains(lower(text), q))"
CENTROID = "m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2), unit AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM m)"


#: Names as in N5: letters beyond ASCII count as letters at a word's edge (here as _), other characters beyond ASCII do not (here as ~).
MENTIONS = rf"""{BLOCKS},
plain AS (SELECT book_id, chapter_id, ordinal, regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{{L}}\p{{N}}]', '~', 'g'), '[^\x00-\x7F]', '_', 'g') AS t, text AS whole FROM b),
cut AS (SELECT book_id, chapter_id, ordinal, whole, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT *, string_split(regexp_replace(t, '(\b[A-Z][a-z]+(?:[\s''-]+[A-Z][a-z]+){{0,3}}\b)', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM plain)),
placed AS (SELECT *, CAST(coalesce(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY book_id, chapter_id, ordinal ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos FROM cut),
found AS (SELECT book_id, chapter_id, ordinal, split_part(piece, chr(2), 1) AS text, pos, whole, regexp_extract(left(whole, pos), '(\S)\s*$', 1) AS last FROM placed WHERE i > 1),
m AS (SELECT book_id, chapter_id, ordinal, text, pos AS "offset" FROM found WHERE (contains(text, ' ') OR NOT (pos = 0 OR last IN ('.', '!', '?') OR (last = '' AND left(whole, 1) = chr(10)))) AND lower(text) NOT IN ({', '.join(f"'{w}'" for w in COMMON_WORDS)}))"""
ENTITIES = """names AS (SELECT DISTINCT book_id, lower(text) AS v FROM m),
canon AS (SELECT book_id, v, coalesce((SELECT arg_min(w.v, struct_pack(a := -length(w.v), b := w.v)) FROM names w WHERE w.book_id = n.book_id AND w.v <> n.v AND contains(w.v, n.v)), v) AS c FROM names n),
said AS (SELECT m.book_id, 'entity_' || left(replace(c, ' ', '_'), 50) AS entity_id, CASE WHEN lower(m.text) = c THEN m.text END AS text, chapter_id FROM m JOIN canon ON canon.book_id = m.book_id AND canon.v = lower(m.text)),
e AS (SELECT book_id, entity_id, min(text) AS text, count(*) AS frequency, list_sort(list(DISTINCT chapter_id)) AS chapter_ids FROM said GROUP BY 1, 2 HAVING count(*) >= 3)"""
COOCCURRENCE = """wanted AS (SELECT canon.book_id, v, e.entity_id FROM canon JOIN e ON e.book_id = canon.book_id AND e.entity_id = 'entity_' || left(replace(c, ' ', '_'), 50)),
parts AS (SELECT book_id, chapter_id, entity_id, v, string_split(t, v) AS p FROM (SELECT source AS book_id, doc_id AS chapter_id, lower(replace(text, chr(10), ' ')) AS t FROM documents) JOIN wanted USING (book_id) WHERE contains(t, v)),
pieces AS (SELECT book_id, chapter_id, entity_id, v, len(p) AS k, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM parts),
occ AS (SELECT book_id, chapter_id, entity_id, pos FROM (SELECT *, sum(length(piece) + length(v)) OVER (PARTITION BY book_id, chapter_id, entity_id, v ORDER BY i) - length(v) AS pos FROM pieces) WHERE i < k),
co AS (SELECT a.book_id, a.entity_id AS e1, b.entity_id AS e2, count(*) AS n FROM occ a JOIN occ b ON a.book_id = b.book_id AND a.chapter_id = b.chapter_id AND a.entity_id <> b.entity_id AND b.pos BETWEEN a.pos - 500 AND a.pos + 500 GROUP BY 1, 2, 3)"""
EVENTS = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, e1 ORDER BY n DESC, e2) AS r FROM co) WHERE r <= 3 AND n >= 3),
met AS (SELECT best.book_id, least(e1, e2) || '_' || greatest(e1, e2) AS event_id, CASE WHEN e1 < e2 THEN [x.text, y.text] ELSE [y.text, x.text] END AS who, list_sort(list_intersect(x.chapter_ids, y.chapter_ids)) AS ids FROM best JOIN ranked x ON x.book_id = best.book_id AND x.entity_id = e1 JOIN ranked y ON y.book_id = best.book_id AND y.entity_id = e2),
ev AS (SELECT book_id, event_id, min(who) AS who, min(ids) AS ids FROM met WHERE len(ids) > 0 GROUP BY 1, 2),
events_ AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY len(ids) DESC, event_id) AS INT) AS rank FROM ev)"""
SALIENCE = """size AS (SELECT source AS book_id, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1),
words AS (SELECT book_id, entity_id, chapter_id, unnest(string_split(lower(text), ' ')) AS term FROM (SELECT book_id, entity_id, text, unnest(chapter_ids) AS chapter_id FROM e)),
boost AS (SELECT w.book_id, entity_id, sum(tfidf / 10) AS boost FROM words w JOIN kw USING (book_id, chapter_id, term) GROUP BY 1, 2),
scored AS (SELECT e.*, round((0.4 * least(1.0, frequency / 50) + 0.4 * least(1.0, len(chapter_ids) / greatest(1, n // 3)) + least(0.3, coalesce(boost, 0.0) / greatest(1, len(chapter_ids)))) * CASE WHEN len(chapter_ids) >= 2 THEN 1.0 ELSE 0.5 END, 6) AS salience FROM e JOIN size USING (book_id) LEFT JOIN boost USING (book_id, entity_id)),
ranked AS (SELECT * FROM (SELECT book_id, entity_id, text, frequency, chapter_ids, salience, CAST(row_number() OVER (PARTITION BY book_id ORDER BY salience DESC, entity_id) AS INT) AS rank FROM scored) WHERE rank <= 500)"""


def _patterns(patterns: list[tuple[str, float]]) -> str:
    tests = [f"CASE WHEN regexp_matches(question, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0.0 END" for p, w in patterns]
    return f"CAST(greatest({', '.join(tests)}) AS DOUBLE)"


def _mentions(column: str) -> str:
    return f"len(list_filter(string_split(lower(coalesce({column}, '')), ' '), lambda w: length(w) > 3 AND contains(lower(question), w))) > 0"


_STRIPPED = "html"
_STRIPPED = f"regexp_replace({_STRIPPED}, '<[^>]+>', '', 'g')"
for _entity, _plain in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''")]:
    _STRIPPED = f"replace({_STRIPPED}, '{_entity}', '{_plain}')"
_STRIPPED = rf"regexp_replace({_STRIPPED}, '[ \t\n\x0B\f\r]+', ' ', 'g')"


def _cosine(a: str, b: str) -> str:
    d = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    return f"round({d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)})), 6)"


#: Archives of four documents each, as the queries make them.
ARCHIVES = "b AS (SELECT doc_id // 4 AS b, CAST(row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) - 1 AS INT) AS i, *, '<html><body><p>' || coalesce(text, '') || '</p></body></html>' AS html FROM documents), ok AS (SELECT * FROM b WHERE b % 7 <> 0), bad AS (SELECT DISTINCT CAST(b AS VARCHAR) AS path FROM b WHERE b % 7 = 0)"

SQL = {
    "n2_keywords": f"WITH {KEYWORDS} SELECT * FROM kw",
    "n3_bigrams": f"WITH {_scored(BI, 'TRUE', 30)} SELECT * FROM kw",
    "a1_term_frequency": f"WITH {TOKENS}, {UNI} SELECT book_id, chapter_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, max(tf) AS max_tf FROM tf GROUP BY 1, 2",
    "a2_document_frequency": f"WITH {TOKENS}, {UNI} SELECT book_id, term, count(*) AS df FROM tf GROUP BY 1, 2",
    "n4_vocabulary": f"WITH {KEYWORDS}, {VOCAB} SELECT * FROM vocab",
    "n4_vectors": f"WITH {KEYWORDS}, {VOCAB} SELECT book_id, chapter_id, index, tfidf AS value FROM kw JOIN vocab USING (book_id, term)",
    "n5_mentions": f'WITH {MENTIONS} SELECT * FROM m',
    "n6_entities": f"WITH {MENTIONS}, {ENTITIES} SELECT book_id, entity_id, text, frequency, array_to_string(chapter_ids, ',') AS chapter_ids FROM e",
    "n9_salience": f"WITH {KEYWORDS}, {MENTIONS}, {ENTITIES}, {SALIENCE} SELECT book_id, entity_id, text, frequency, array_to_string(chapter_ids, ',') AS chapter_ids, CAST(salience AS DOUBLE) AS salience, rank FROM ranked",
    "n8_cooccurrence": f"WITH {MENTIONS}, {ENTITIES}, {COOCCURRENCE} SELECT * FROM co",
    "n13_events": f"WITH {KEYWORDS}, {MENTIONS}, {ENTITIES}, {SALIENCE}, {COOCCURRENCE}, {EVENTS} SELECT book_id, event_id, array_to_string(who, ';') AS participants, array_to_string(ids, ',') AS chapter_ids, 'Interaction: ' || array_to_string(who, ' & ') AS label, rank FROM events_ WHERE rank <= 500",
    "t4_entity_top": f"WITH {KEYWORDS}, {MENTIONS}, {ENTITIES}, {SALIENCE} SELECT book_id, entity_id, rank FROM ranked",
    "p7_block_ids": rf"WITH {BLOCKS} SELECT book_id, chapter_id, ordinal, substr(sha256(chapter_id || '|' || lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) || '|' || ordinal), 1, 12) AS block_id, greatest(1, length(text) // 4) AS tokens FROM b",
    "w2_block_offsets": f"WITH {BLOCKS} SELECT book_id, chapter_id, ordinal, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY book_id, chapter_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM b",
    "a10_structure": f"WITH {BLOCKS} SELECT book_id, chapter_id, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM b GROUP BY 1, 2",
    "a12_full_text": "SELECT source AS book_id, doc_id AS chapter_id, sha256(replace(text, chr(10), chr(10) || chr(10))) AS text_sha256, length(replace(text, chr(10), '##')) AS n_chars FROM documents",
    "w11_position_percent": f"WITH {BLOCKS} SELECT book_id, chapter_id, ordinal, CAST(round((ordinal + 1) / count(*) OVER (PARTITION BY book_id, chapter_id) * 100) AS INT) AS percent FROM b",
    "n1_chunks": f"""WITH RECURSIVE {BLOCKS},
sized AS (SELECT *, greatest(1, length(text) // 4) AS t FROM b),
p AS (SELECT *, sum(t) OVER w AS upto, sum(length(text) + 1) OVER w - length(text) - 1 AS pos, count(*) OVER (PARTITION BY book_id, chapter_id) AS n FROM sized WINDOW w AS (PARTITION BY book_id, chapter_id ORDER BY ordinal)),
doc AS (SELECT book_id, chapter_id, any_value(n) AS n, list(upto ORDER BY ordinal) AS u, list(pos ORDER BY ordinal) AS st, list(text ORDER BY ordinal) AS tx FROM p GROUP BY 1, 2),
fold AS (
  SELECT book_id, chapter_id, 0 AS k, 0 AS s, 0 AS f, n, u FROM doc
  UNION ALL
  SELECT book_id, chapter_id, k + 1, CASE WHEN j IS NULL OR j > i THEN i ELSE greatest(s, j) END, i, n, u
  FROM (SELECT *, (SELECT min(x) FROM range(s, i) r(x) WHERE u[i] - (CASE WHEN x = 0 THEN 0 ELSE u[x] END) <= 80) AS j
        FROM (SELECT *, (SELECT min(x) FROM range(f + 1, n) r(x) WHERE u[x + 1] - (CASE WHEN s = 0 THEN 0 ELSE u[s] END) > 800) AS i FROM fold) WHERE i IS NOT NULL)),
cut AS (SELECT *, lead(f) OVER (PARTITION BY book_id, chapter_id ORDER BY k) AS e FROM fold),
done AS (SELECT book_id, chapter_id, k AS ordinal, s, coalesce(e, c.n) AS e, tx[s + 1 : coalesce(e, c.n)] AS parts, st, tx FROM cut c JOIN doc d USING (book_id, chapter_id))
SELECT substr(sha256(book_id || '|' || chapter_id || '|' || ordinal), 1, 16) AS chunk_id, book_id, chapter_id, ordinal, sha256(array_to_string(parts, chr(10))) AS text_sha256,
  greatest(1, length(array_to_string(parts, chr(10))) // 4) AS token_count, e - s AS n_blocks, CAST(st[s + 1] AS BIGINT) AS start_offset, CAST(st[e] + length(tx[e]) AS BIGINT) AS end_offset FROM done""",
    "p9_lexical_search": f"WITH {BLOCKS}, {ASKED} SELECT * FROM hit",
    "t3_lexical_display": f"WITH {BLOCKS}, {ASKED} SELECT query_id, rank, book_id, chapter_id, ordinal, total, greatest(total - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY book_id, chapter_id, ordinal) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM hit) WHERE rank <= 10",
    "w4_surrounding": f"WITH {BLOCKS}, {ASKED}, centres AS (SELECT DISTINCT book_id, chapter_id, ordinal AS centre FROM hit) SELECT book_id, chapter_id, centre, ordinal, length(text) AS n_chars FROM centres JOIN b USING (book_id, chapter_id) WHERE abs(ordinal - centre) <= 2",
    "p5_strip_html": f"SELECT page_id, length({_STRIPPED}) AS n_chars, sha256({_STRIPPED}) AS text_sha256 FROM pages",
    "p6_block_types": """SELECT page_id, tag, count(*) AS n, CASE lower(tag) WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'listItem' WHEN 'td' THEN 'listItem' WHEN 'blockquote' THEN 'blockquote' WHEN 'pre' THEN 'preformatted' WHEN 'img' THEN 'image'
  ELSE CASE WHEN regexp_full_match(lower(tag), 'h[1-6]') THEN 'heading' || tag[2] ELSE 'unknown' END END AS type
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2""",
    "p13_css": rf"SELECT id, regexp_replace(regexp_replace(regexp_replace(css, '(?i)margin-(left|right)\s*:\s*(\d+)%\s*;', '/* [sanitized margin-\1] */', 'g'), '(?i)padding(-left|-right)?\s*:\s*[^;]*\d+%[^;]*;', '/* [sanitized padding] */', 'g'), '(?i)width\s*:\s*\d+%\s*;', '/* [sanitized width] */', 'g') AS css FROM ({in_duckdb('css')})",
    "p15_visible_block": f"SELECT view_id, arg_min(block_id, y0) AS block_id FROM ({in_duckdb('boxes')}) WHERE y0 < view_bottom AND y1 > view_top GROUP BY 1",
    "j1_spine_manifest": f"SELECT book_id, pos, idref, href, media_type FROM ({in_duckdb('spine')}) s JOIN (SELECT *, id AS idref FROM ({in_duckdb('manifest')})) m USING (book_id, idref)",
    "j2_navigation_labels": f"""WITH p AS (SELECT *, split_part(src, '#', 1) AS target FROM ({in_duckdb('points')})), m AS ({in_duckdb('manifest')})
SELECT m.book_id, id AS spine_item_id, href, arg_max(label, ord) AS ncx_label FROM m LEFT JOIN p ON p.book_id = m.book_id AND (ends_with(href, target) OR ends_with(target, href)) GROUP BY 1, 2, 3""",
    "j3_section_labels": f"SELECT book_id, spine_item_id, coalesce(ncx_label, title, 'Untitled') AS label FROM ({in_duckdb('sections')})",
    "s8_resources": f"""WITH r AS (SELECT DISTINCT * FROM ({in_duckdb('requests')})), f AS ({in_duckdb('files')}),
fit AS (SELECT r.book_id, request, path, CASE WHEN path = request THEN 1 WHEN regexp_extract(path, '[^/]*$') = regexp_extract(request, '[^/]*$') THEN 2 WHEN ends_with(path, request) OR ends_with(request, path) THEN 3 END AS fit FROM r JOIN f USING (book_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, request ORDER BY fit, path) AS n FROM fit WHERE fit IS NOT NULL) WHERE n = 1)
SELECT book_id, r.request, path, fit, CASE lower(regexp_extract(coalesce(path, ''), '[A-Za-z0-9]+$')) WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS media_type FROM r LEFT JOIN best USING (book_id, request)""",
    "tool_lexical_search": f"""WITH {BLOCKS}, r AS (SELECT doc_id AS query_id, source, lower(substr(text, 1, 6)) AS q FROM documents WHERE doc_id % 100 = 0),
hit AS (SELECT query_id, chapter_id, ordinal, text, row_number() OVER w AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM r JOIN b ON book_id = source AND (query_id % 200 = 0 OR chapter_id = query_id) AND length(q) > 0 AND contains(lower(text), q) WINDOW w AS (PARTITION BY query_id ORDER BY chapter_id, ordinal))
SELECT query_id, rank, chapter_id, 'Chapter ' || chapter_id AS label, ordinal, sha256(text) AS text_sha256, total, greatest(total - 10, 0) AS more FROM hit WHERE rank <= 10""",
    "tool_surrounding_context": rf"""WITH {BLOCKS}, k AS (SELECT *, substr(sha256(chapter_id || '|' || lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) || '|' || ordinal), 1, 12) AS id FROM b)
SELECT c.chapter_id AS query_id, k.id AS block_id, k.ordinal, length(k.text) AS n_chars FROM k c JOIN k ON c.book_id = k.book_id AND c.chapter_id = k.chapter_id AND k.ordinal <= 2 WHERE c.ordinal = 0 AND c.chapter_id % 100 = 0 AND (c.chapter_id % 200 = 0 OR c.chapter_id % 300 <> 0)""",
    "tool_chapter_full_text": "SELECT doc_id AS query_id, CASE WHEN known THEN doc_id END AS chapter_id, CASE WHEN known THEN 'Chapter ' || doc_id END AS label, CASE WHEN known THEN sha256(replace(text, chr(10), chr(10) || chr(10))) END AS text_sha256 FROM (SELECT *, doc_id % 200 = 0 OR doc_id % 300 <> 0 AS known FROM documents WHERE doc_id % 100 = 0)",
    "tool_semantic_search_scoped": f"SELECT query_id, rank, vec_id, label AS chapter_id, CAST(trunc(score * 100) AS INT) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, v.label, {_cosine('q.embedding', 'v.embedding')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 300 = 0 OR q.label = v.label OR (q.vec_id % 300 = 200 AND v.label = 0) WHERE q.vec_id % 100 = 0)) JOIN documents ON doc_id = vec_id WHERE rank <= 10",
    "s9_vector_index": "SELECT source AS book_id, doc_id AS chunk_id, length(text) AS n_chars, len(embedding) AS dim FROM documents JOIN embeddings ON doc_id = vec_id WHERE source <> 'src1'",
    "s10_deleted": "SELECT source AS book_id, count(*) AS n FROM documents WHERE source <> 'src1' GROUP BY 1",
    "u4_sparse_cosine": f"WITH {KEYWORDS}, {VOCAB}, v AS (SELECT book_id, chapter_id, index, tfidf AS x FROM kw JOIN vocab USING (book_id, term)), norms AS (SELECT book_id, chapter_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1, 2) SELECT p.book_id, p.a, p.b, CASE WHEN a.n * b.n > 0 THEN round(dot / (a.n * b.n), 6) ELSE CAST(0 AS DOUBLE) END AS similarity FROM (SELECT l.book_id, l.chapter_id AS a, r.chapter_id AS b, sum(l.x * r.x) AS dot FROM v l JOIN v r ON l.book_id = r.book_id AND l.index = r.index AND l.chapter_id <> r.chapter_id WHERE l.chapter_id % 100 = 0 GROUP BY 1, 2, 3) p JOIN norms a ON a.book_id = p.book_id AND a.chapter_id = p.a JOIN norms b ON b.book_id = p.book_id AND b.chapter_id = p.b",
    "n18_guardrails": "WITH e AS (SELECT user_id AS question_id, event_id AS seq, event_id % 13 > 10 AS late, event_id % 3 = 0 AND event_id % 13 <= 10 AS esc FROM events), c AS (SELECT *, NOT late AND NOT (esc AND sum(CAST(esc AS INT)) OVER w > 1) AS ok FROM e WINDOW w AS (PARTITION BY question_id ORDER BY seq)), u AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY question_id ORDER BY seq) AS used FROM c) SELECT question_id, seq, ok AND used <= 8 AS allowed, CASE WHEN late THEN 'round' WHEN NOT ok THEN 'escalation' WHEN used > 8 THEN 'budget' END AS refused FROM u",
    "json_arguments": f"""SELECT id, CASE WHEN ok THEN json_extract_string(arguments, '$.query') END AS query, CASE WHEN ok THEN json_extract_string(arguments, '$.scope') END AS scope, CASE WHEN ok THEN CAST(json_extract_string(arguments, '$.limit') AS INT) END AS most
FROM (SELECT id, CASE WHEN json_valid(arguments) THEN arguments ELSE 'null' END AS arguments, json_valid(arguments) AND starts_with(trim(arguments), '{{') AS ok FROM ({in_duckdb('tool_calls')}))""",
    "iso_times": f"SELECT id, CASE WHEN contains(t, 'T') THEN CAST(floor(epoch(TRY_CAST(replace(t, 'Z', '+00:00') AS TIMESTAMPTZ))) AS BIGINT) END AS seconds FROM ({in_duckdb('times')})",
    "s12_summaries": f"""WITH r AS (SELECT query, status, CASE WHEN json_valid(body) THEN body END AS j FROM ({in_duckdb('encyclopedia')})),
o AS (SELECT *, CASE WHEN status = 404 THEN 'not_found' WHEN status NOT BETWEEN 200 AND 299 THEN 'http_error' WHEN j IS NULL OR json_extract_string(j, '$.title') IS NULL OR json_extract_string(j, '$.extract') IS NULL THEN 'invalid' ELSE 'found' END AS outcome FROM r)
SELECT query, outcome, CASE outcome WHEN 'found' THEN json_extract_string(j, '$.title') END AS title, CASE outcome WHEN 'found' THEN json_extract_string(j, '$.description') END AS description, CASE outcome WHEN 'found' THEN json_extract_string(j, '$.extract') END AS extract,
CASE outcome WHEN 'found' THEN coalesce(json_extract_string(j, '$.thumbnail.source'), json_extract_string(j, '$.originalimage.source')) END AS image, CASE outcome WHEN 'found' THEN json_extract_string(j, '$.content_urls.desktop.page') END AS page FROM o""",
    "s12_search": f"""SELECT query, CAST(rank AS INT) AS rank, json_extract_string(hit, '$.title') AS title, regexp_replace(json_extract_string(hit, '$.snippet'), '<[^>]+>', '', 'g') AS snippet
FROM (SELECT query, generate_subscripts(hits, 1) AS rank, unnest(hits) AS hit FROM (SELECT query, json_extract(body, '$.query.search[*]') AS hits FROM ({in_duckdb('encyclopedia_search')}) WHERE status BETWEEN 200 AND 299))""",
    "s12_places": f"""WITH p AS (SELECT query, generate_subscripts(ps, 1) AS rank, unnest(ps) AS p FROM (SELECT query, CASE WHEN starts_with(ltrim(body), '[') THEN json_extract(body, '$[*]') ELSE [CAST(body AS JSON)] END AS ps FROM ({in_duckdb('place_search')}) WHERE status BETWEEN 200 AND 299))
SELECT query, CAST(rank AS INT) AS rank, TRY_CAST(json_extract_string(p, '$.lat') AS DOUBLE) AS lat, TRY_CAST(json_extract_string(p, '$.lon') AS DOUBLE) AS lon, coalesce(json_extract_string(p, '$.name'), string_split(json_extract_string(p, '$.display_name'), ',')[1]) AS name,
coalesce(nullif(concat_ws(', ', json_extract_string(p, '$.address.road'), coalesce(json_extract_string(p, '$.address.city'), json_extract_string(p, '$.address.town'), json_extract_string(p, '$.address.village')), json_extract_string(p, '$.address.state'), json_extract_string(p, '$.address.country')), ''), json_extract_string(p, '$.display_name')) AS address
FROM p WHERE TRY_CAST(json_extract_string(p, '$.lat') AS DOUBLE) IS NOT NULL AND TRY_CAST(json_extract_string(p, '$.lon') AS DOUBLE) IS NOT NULL""",
    "j12_links": f"""WITH a AS (SELECT book_id, link, split_part(link, '#', 1) AS path, nullif(regexp_extract(link, '#(.*)$', 1), '') AS fragment FROM ({in_duckdb('anchors')})), m AS ({in_duckdb('manifest')}),
by_file AS (SELECT book_id, regexp_extract(href, '[^/]*$') AS file, min(id) AS id FROM m GROUP BY 1, 2), by_path AS (SELECT book_id, href AS path, min(id) AS id FROM m GROUP BY 1, 2),
x AS (SELECT a.*, CASE WHEN a.path <> '' THEN coalesce(p.id, f.id) END AS id FROM a LEFT JOIN by_file f ON f.book_id = a.book_id AND f.file = regexp_extract(a.path, '[^/]*$') LEFT JOIN by_path p ON p.book_id = a.book_id AND p.path = a.path)
SELECT book_id, link, CASE WHEN regexp_matches(link, '^https?://') THEN 'external' WHEN path = '' THEN 'anchor' WHEN id IS NOT NULL THEN 'internal' ELSE 'unknown' END AS kind, CASE WHEN NOT regexp_matches(link, '^https?://') THEN id END AS spine_item_id, fragment FROM x""",
    "s14_new_books": f"SELECT * FROM ({in_duckdb('found')}) f WHERE lower(title) NOT IN (SELECT lower(title) FROM ({in_duckdb('owned')}))",
    "chapter_id_resolution": f"SELECT r.book_id, chapter_id, current_id, CASE WHEN chapter_id = 'current' THEN current_id ELSE spine_item_id END AS resolved FROM ({in_duckdb('chapter_requests')}) r LEFT JOIN ({in_duckdb('sections')}) s ON s.book_id = r.book_id AND chapter_id = spine_item_id",
    "t1_library_order": f"SELECT book_id, row_number() OVER (ORDER BY last_opened_ts DESC NULLS LAST, import_ts DESC, book_id) AS place FROM ({in_duckdb('library')})",
    "s11_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT user_id, event_type, event_id, round(value, 6) AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "k14_cascade_delete": "SELECT source AS book_id, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src7') GROUP BY 1",
    "w5_turns": "SELECT conv_id, turn, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer, CASE WHEN nr = 'assistant' AND nt IS NOT NULL THEN 'complete' ELSE 'pending' END AS state FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'",
    "t2_conversation_order": "SELECT conv_id, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1",
    "n18_budget": "SELECT user_id AS question_id, count(*) FILTER (n <= 8) AS n_allowed, count(*) FILTER (n > 8) AS n_refused, count(*) FILTER (n <= 8 AND event_id % 5 <> 0) AS n_evidence, count(*) FILTER (n <= 8 AND event_id % 5 <> 0) >= 1 AS grounded FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY 1",
    "a9_trace_time": "SELECT user_id AS trace_id, round(sum(CASE WHEN event_id % 4 IN (1, 2) THEN round(value, 3) ELSE 0.0 END), 6) AS seconds, count(*) AS n_steps, count(*) FILTER (event_id % 4 = 2) AS n_tools FROM events GROUP BY 1",
    "n16_router": f"""WITH q AS (SELECT conv_id || ':' || turn AS question_id, text AS question, 'Frankenstein or the Modern Tale' AS title, 'Mary Shelley' AS author FROM conversations WHERE role = 'user' UNION ALL SELECT question_id, question, title, author FROM ({FIXTURES['questions']})),
s AS (SELECT *, {_patterns(BOOK_PATTERNS)} AS b, {_patterns(OTHER_PATTERNS)} AS o, regexp_matches(lower(question), '^({'|'.join(QUESTION_WORDS)})') AND length(question) < 50 AS short FROM q)
SELECT question_id, CASE WHEN {_mentions('title')} OR {_mentions('author')} OR (b >= 0.8 AND b > o) THEN 'book' WHEN o >= 0.8 AND o > b THEN 'not_book' ELSE 'ambiguous' END AS route,
CAST(CASE WHEN {_mentions('title')} THEN 0.9 WHEN {_mentions('author')} THEN 0.85 WHEN b >= 0.8 AND b > o THEN b WHEN o >= 0.8 AND o > b THEN o WHEN short THEN 0.5 ELSE greatest(b, o, 0.4) END AS DOUBLE) AS confidence FROM s""",
    "w6_global_page": f"WITH {COUNTS}, q AS (SELECT book_id, spine_index * 2 AS spine_index, 3 AS local_page FROM c) SELECT q.*, CAST(coalesce(first_page + local_page, 1) AS BIGINT) AS global_page FROM q LEFT JOIN s USING (book_id, spine_index)",
    "w7_starting_page": f"WITH {COUNTS}, q AS (SELECT book_id, spine_index * 2 - 1 AS spine_index FROM c), t AS (SELECT book_id, count(*) AS n, sum(pages) AS pages FROM c GROUP BY 1) SELECT q.*, CAST(CASE WHEN q.spine_index <= 0 OR q.spine_index > n THEN 1 WHEN q.spine_index = n THEN t.pages + 1 ELSE first_page END AS BIGINT) AS starting_page FROM q JOIN t USING (book_id) LEFT JOIN s USING (book_id, spine_index)",
    "w8_local_position": f"""WITH {COUNTS}, q AS (SELECT book_id, spine_index * 7 - 1 AS global_page FROM c),
last AS (SELECT book_id, max(spine_index) AS ls, arg_max(pages, spine_index) AS lp FROM c GROUP BY 1)
SELECT q.book_id, global_page, CAST(CASE WHEN global_page < 1 THEN 0 ELSE coalesce(s.spine_index, ls) END AS INT) AS spine_index, CAST(CASE WHEN global_page < 1 THEN 0 WHEN s.spine_index IS NULL THEN lp - 1 ELSE global_page - first_page END AS BIGINT) AS local_page
FROM q JOIN last USING (book_id) LEFT JOIN s ON s.book_id = q.book_id AND global_page >= first_page AND global_page < first_page + pages""",
    "a8_page_totals": f"WITH {COUNTS} SELECT book_id, CAST(sum(pages) AS BIGINT) AS pages FROM c GROUP BY 1",
    "locations": f"WITH {COUNTS} SELECT book_id, spine_index, i, i * 1024 AS char_offset FROM c, unnest(range(0, greatest(1, length // 1024))) AS r(i)",
    "w10_boundaries": f"WITH {COUNTS} SELECT book_id, spine_index, greatest(1, length // 1024) AS n, CAST(coalesce(sum(greatest(1, length // 1024)) OVER (PARTITION BY book_id ORDER BY spine_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS boundary FROM c",
    "w10_spine_of_location": f"WITH {COUNTS}, x AS (SELECT book_id, spine_index, coalesce(sum(greatest(1, length // 1024)) OVER (PARTITION BY book_id ORDER BY spine_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS boundary FROM c), q AS (SELECT book_id, spine_index * 3 AS location FROM c) SELECT q.book_id, location, max(spine_index) AS spine_index FROM q JOIN x ON x.book_id = q.book_id AND boundary <= location GROUP BY 1, 2",
    "cfi_generate": f"WITH {COUNTS} SELECT book_id, spine_index, 'epubcfi(/6/' || (spine_index + 1) * 2 || '[ch' || spine_index || ']!/' || (spine_index % 5 + 1) * 2 || '/2:' || length || ')' AS cfi, 'epubcfi(/6/' || (spine_index + 1) * 2 || '!)' AS base FROM c",
    "cfi_parse": rf"""WITH x AS (SELECT id AS doc, cfi, TRY_CAST(regexp_extract(cfi, '^epubcfi\(/6/(\d+).*\)', 1) AS INT) AS n, nullif(regexp_extract(cfi, '^epubcfi\(/6/\d+\[([^\]]*)\]', 1), '') AS id, ends_with(cfi, ')') AS whole,
  regexp_extract(cfi, '!([^:]*?)(:.*)?\)$', 1) AS path, TRY_CAST(regexp_extract(cfi, ':([^:]*)\)$', 1) AS INT) AS off FROM ({in_duckdb('cfis')})),
y AS (SELECT *, n > 0 AND n % 2 = 0 AS ok, list_transform(list_filter(list_transform(string_split(path, '/'), lambda p: TRY_CAST(regexp_extract(p, '^\d+') AS INT)), lambda v: v > 0 AND v % 2 = 0), lambda v: v // 2 - 1) AS dom FROM x)
SELECT doc AS id, cfi, CASE WHEN ok THEN n // 2 - 1 END AS base_spine, CASE WHEN ok THEN id END AS base_idref, CASE WHEN ok AND whole THEN n // 2 - 1 END AS spine, CASE WHEN ok AND whole THEN id END AS idref, CASE WHEN ok AND whole THEN array_to_string(dom, ',') END AS dom_path, CASE WHEN ok AND whole THEN off END AS char_offset FROM y""",
    "swipe": f"""WITH g AS ({in_duckdb('swipes')}),
x AS (SELECT *, greatest(0, total_pages - 1) AS last FROM g)
SELECT id, CAST(start_page AS INT) AS start_page, CAST(current_page AS INT) AS current_page, CAST(total_pages AS INT) AS total_pages, CAST(velocity AS DOUBLE) AS velocity, CAST(spine_index AS INT) AS spine_index, CAST(total_spines AS INT) AS total_spines,
 CASE WHEN velocity > 0.5 AND start_page >= last THEN CASE WHEN spine_index + 1 < total_spines THEN 'transition_forward' ELSE 'bounce' END WHEN velocity < -0.5 AND start_page <= 0 THEN CASE WHEN spine_index > 0 THEN 'transition_backward' ELSE 'bounce' END ELSE 'snap' END AS action,
 CAST(CASE WHEN velocity > 0.5 THEN CASE WHEN start_page < last THEN least(start_page + 1, last) END WHEN velocity < -0.5 THEN CASE WHEN start_page > 0 THEN start_page - 1 END ELSE greatest(0, least(current_page, last)) END AS INT) AS page FROM x""",
    "scrubber": f"WITH {COUNTS}, t AS (SELECT book_id, sum(pages) AS total FROM c GROUP BY 1) SELECT book_id, CAST(page AS INT) AS page, round((page - 1) / greatest(1, total - 1), 6) AS value, CAST(page AS INT) AS back FROM t, unnest(range(1, CAST(total AS INT) + 1)) AS r(page)",
    "formatting": "SELECT p_partkey, CASE WHEN floor(p_retailprice / 100) / 10 < 1 THEN printf('$%.2f', floor(p_retailprice / 100) / 10) ELSE printf('$%.0f', floor(p_retailprice / 100) / 10) END AS price, CASE WHEN p_partkey * 12500 < 1000000 THEN (p_partkey * 12500 // 1000) || 'K' WHEN p_partkey * 12500 % 1000000 = 0 THEN (p_partkey * 12500 // 1000000) || 'M' ELSE format('{:.1f}M', round(p_partkey / 80.0, 1)) END AS context, least(greatest(p_size / 10, 1.0), 2.2) AS font, CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '...' ELSE p_name END AS preview FROM part",
    "headers_to_bold": rf"SELECT id, sha256(regexp_replace(text, '(?m)^(#{{1,6}})\s+(.+)$', '**\2**', 'g')) AS text_sha256 FROM ({in_duckdb('markdown')})",
    "short_address": f"SELECT id, coalesce(nullif(concat_ws(', ', road, coalesce(city, town, village), state, country), ''), name) AS address FROM ({in_duckdb('addresses')})",
    "selection_context": "SELECT doc_id, sha256(CASE WHEN instr(text, s) > 0 THEN substring(text, greatest(1, instr(text, s) - 60), instr(text, s) + length(s) + 60 - greatest(1, instr(text, s) - 60)) ELSE s END) AS context_sha256 FROM (SELECT *, substring(text, 40, 12) AS s FROM documents)",
    "n10_similar_pairs": f"""WITH {KEYWORDS}, {VOCAB}, v AS (SELECT book_id, chapter_id, index, tfidf AS x FROM kw JOIN vocab USING (book_id, term) WHERE tfidf <> 0),
u AS (SELECT book_id, chapter_id, index, round(x / sqrt(sum(x * x) OVER (PARTITION BY book_id, chapter_id)), 12) AS x FROM v),
k AS (SELECT book_id, chapter_id, string_agg(index || ':' || x, ',' ORDER BY index) AS k FROM u GROUP BY 1, 2),
c AS (SELECT book_id, chapter_id, min(chapter_id) OVER same AS class_id, count(*) OVER same AS n FROM k WINDOW same AS (PARTITION BY book_id, k)),
r AS (SELECT u.*, n FROM u JOIN c USING (book_id, chapter_id) WHERE chapter_id = class_id)
SELECT l.book_id, l.chapter_id AS a, r.chapter_id AS b, round(sum(l.x * r.x), 6) AS similarity, any_value(l.n) AS n_a, any_value(r.n) AS n_b
FROM r l JOIN r ON l.book_id = r.book_id AND l.index = r.index AND l.chapter_id < r.chapter_id GROUP BY 1, 2, 3 HAVING round(sum(l.x * r.x), 6) >= 0.3""",
    "v2_nearest": f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_cosine('q.embedding', 'v.embedding')} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10",
    "v2_nearest_scoped": f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_cosine('q.embedding', 'v.embedding')} AS score FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 100 = 0)) WHERE rank <= 5",
    "a7_centroids": f"WITH {CENTROID} SELECT label, i, round(x, 6) AS x FROM unit",
    "n10_similarity": f"WITH {CENTROID} SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS similarity FROM unit a JOIN unit b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2",
    "l2_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, 1.0 AS unit FROM embeddings",
    "a11_build_stats": f"WITH {BLOCKS} SELECT book_id, count(DISTINCT chapter_id) AS n_chapters, count(*) AS n_blocks FROM b GROUP BY 1",
    "p12_body": "WITH x AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END AS b FROM pages) SELECT page_id, length(b) AS n_chars, sha256(b) AS body_sha256 FROM x",
    "p12_self_closing": rf"SELECT page_id, length(h) AS n_chars, sha256(h) AS html_sha256 FROM (SELECT page_id, regexp_replace(regexp_replace(replace(html, '<Span', '<span'), '<([a-zA-Z][a-zA-Z0-9]*)([^>]*?)\s*/>', '<\1\2></\1>', 'g'), '<(br|hr|img)([^>]*)></(?:br|hr|img)>', '<\1\2/>', 'g') AS h FROM pages)",
    "p14_linked_styles": rf"""WITH h AS (SELECT book_id, spine_item_id, base_path, generate_subscripts(l, 1) AS place, unnest(l) AS href FROM (SELECT *, regexp_extract_all(html, '(?i)<link[^>]+href\s*=\s*["'']([^"'']+\.css)["''][^>]*>', 1) AS l FROM ({in_duckdb('styled')}))),
f AS ({in_duckdb('styles')}), k AS (SELECT book_id, path AS key, 1 AS how, path, css FROM f UNION ALL SELECT book_id, regexp_extract(path, '[^/]*$'), 2, path, css FROM f),
t AS (SELECT *, CASE WHEN base_path = '' THEN href ELSE base_path || '/' || href END AS whole, regexp_extract(href, '[^/]*$') AS file FROM h),
hit AS (SELECT t.book_id, spine_item_id, place, css, row_number() OVER (PARTITION BY t.book_id, spine_item_id, place ORDER BY CASE key WHEN whole THEN 0 WHEN href THEN 1 ELSE 2 END, how, path, css) AS r FROM t JOIN k ON k.book_id = t.book_id AND key IN (whole, href, file)),
c AS (SELECT book_id, spine_item_id, string_agg(css || chr(10), '' ORDER BY place) AS css FROM hit WHERE r = 1 GROUP BY 1, 2)
SELECT s.book_id, s.spine_item_id, css FROM ({in_duckdb('styled')}) s LEFT JOIN c USING (book_id, spine_item_id)""",
    "p10_title": f"SELECT book_id, title FROM ({in_duckdb('library')}) WHERE contains(lower(title), 'u') ORDER BY last_opened_ts DESC NULLS LAST, import_ts DESC, book_id LIMIT 1",
    "p11_conversations_of_book": f"SELECT conv_id, updated_ts FROM ({in_duckdb('asked_conversations')}) WHERE book_title = '1-URGENT' ORDER BY updated_ts DESC, conv_id",
    "layout_keys": "SELECT p_partkey, printf('%.1f', p_size / 10.0) || '-' || p_size * 2 || '-820-1180' AS layout FROM part",
    "page_arithmetic": r"SELECT doc_id, greatest(1, CAST(ceil(n_chars / 640.0) AS INT)) AS pages, CAST(greatest(0, least(round(n_chars / 3.0 / 640), greatest(1, ceil(n_chars / 640.0)) - 1)) AS INT) AS page, sha256(array_to_string(regexp_split_to_array(regexp_replace(text, '^ +| +$', '', 'g'), '\s+')[1:5], ' ')) AS head_sha256 FROM documents",
    "s10_store": "SELECT source AS book_id, CASE source WHEN 'src1' THEN -count(*) ELSE count(*) END AS n FROM documents GROUP BY 1",
    "v1_index_shape": "SELECT count(*) AS n, min(len(embedding)) AS least, max(len(embedding)) AS most, min(len(embedding)) = max(len(embedding)) AS valid FROM embeddings",
    "tool_current_position": f"WITH {BLOCKS}, s AS (SELECT book_id, chapter_id, count(*) AS n_blocks FROM b GROUP BY 1, 2), p AS (SELECT source || '-' || doc_id AS person_id, source AS book_id, doc_id AS chapter_id, CASE WHEN doc_id % 5 > 0 THEN n_chars % 3 END AS o FROM documents) SELECT person_id, book_id, chapter_id, 'Chapter ' || chapter_id AS label, CAST(CASE WHEN o < n_blocks THEN o + 1 END AS INT) AS block, n_blocks, CAST(CASE WHEN o < n_blocks THEN round((o + 1) / n_blocks * 100) END AS INT) AS percent FROM p JOIN s USING (book_id, chapter_id)",
    "tool_book_structure": f"WITH {BLOCKS} SELECT book_id, chapter_id, 'Chapter ' || chapter_id AS label, count(*) AS n_blocks, chapter_id = min(chapter_id) OVER (PARTITION BY book_id) AS current FROM b GROUP BY 1, 2",
    "tool_semantic_search": f"SELECT query_id, rank, vec_id, label AS chapter_id, CAST(trunc(score * 100) AS INT) AS similarity, sha256(left(text, 300)) AS snippet_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, v.label, {_cosine('q.embedding', 'v.embedding')} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) JOIN documents ON doc_id = vec_id WHERE rank <= 10",
    "tool_chapter_summary": f"""WITH r AS (SELECT r.*, CASE WHEN chapter_id = 'current' THEN current_id ELSE spine_item_id END AS resolved FROM ({in_duckdb('chapter_requests')}) r LEFT JOIN (SELECT book_id, spine_item_id FROM ({in_duckdb('sections')})) s ON s.book_id = r.book_id AND r.chapter_id = spine_item_id)
SELECT r.book_id, r.chapter_id, current_id, resolved, summary, key_points, characters FROM r LEFT JOIN ({in_duckdb('stored_summaries')}) t ON t.book_id = r.book_id AND t.chapter_id = resolved""",
    "j11_gathered_summaries": f"SELECT book_id, count(*) AS n, string_agg(summary, chr(10) || chr(10) ORDER BY place) AS text FROM ({in_duckdb('places')}) JOIN ({in_duckdb('stored_summaries')}) USING (book_id, chapter_id) GROUP BY 1",
    "tool_book_synopsis": f"SELECT l.book_id, title, CAST(NULL AS VARCHAR) AS author, synopsis, characters, themes FROM ({in_duckdb('library')}) l LEFT JOIN ({in_duckdb('stored_synopses')}) s ON l.book_id = s.book_id",
    "summary_replies": """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Order ' || o_orderkey || '. It goes on.' WHEN 1 THEN 'free text ' || o_orderpriority ELSE o_orderstatus END AS summary,
CASE o_orderkey % 3 WHEN 0 THEN 'first ' || o_custkey || ';second' WHEN 1 THEN '' ELSE 'p' || o_custkey END AS key_points, CASE o_orderkey % 3 WHEN 0 THEN 'Ann;Bob;C' || o_custkey ELSE '' END AS characters FROM orders""",
    "synopsis_replies": "SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'All of ' || o_orderkey || '. More.' ELSE 'nothing in ' || o_orderkey END AS synopsis, CASE o_orderkey % 2 WHEN 0 THEN 'Ann=the heroine: ' || o_custkey ELSE '' END AS characters, CASE o_orderkey % 2 WHEN 0 THEN o_orderpriority ELSE '' END AS themes FROM orders",
    "epub_sections": f"""WITH {ARCHIVES} SELECT CAST(b AS VARCHAR) AS path, 'Book ' || b AS title, i AS spine_index, 'c' || doc_id AS spine_item_id, CASE WHEN doc_id % 3 > 0 THEN 'Chapter ' || doc_id END AS ncx_label, CAST(length(html) AS INT) AS n_chars, false AS broken FROM ok
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, true FROM bad""",
    "s2_epub_metadata": f"""WITH {ARCHIVES} SELECT CAST(b AS VARCHAR) AS path, 'Book ' || b AS title, 'A. Writer' AS author, i AS spine_index, 'c' || doc_id AS spine_item_id, 'OPS/s' || i || '.xhtml' AS href, 'application/xhtml+xml' AS media_type, CASE WHEN doc_id % 3 > 0 THEN 'Chapter ' || doc_id END AS ncx_label, true AS unread, false AS broken FROM ok
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true, true FROM bad""",
    "s3_epub_section": f"WITH {ARCHIVES} SELECT CAST(b AS VARCHAR) AS path, i AS spine_index, 'c' || doc_id AS spine_item_id, sha256(html) AS html_sha256 FROM ok WHERE i = 1",
    "s7_images": f"WITH {ARCHIVES} SELECT CAST(b AS VARCHAR) AS path, 'OPS/img/p' || i || '.png' AS resource, 'p' || i || '.png' AS file_name, 'image/png' AS media_type, CAST(strlen(coalesce(source, '')) AS INT) AS n_bytes FROM ok WHERE doc_id % 2 = 0",
}

#: Columns that the queries give as 32-bit integers where DuckDB's functions give 64 bits.
INTEGERS = {
    "n2_keywords": "rank", "n3_bigrams": "rank", "n4_vocabulary": "index", "n4_vectors": "index", "n5_mentions": "ordinal", "p7_block_ids": "ordinal tokens", "w2_block_offsets": "ordinal",
    "a12_full_text": "n_chars", "w11_position_percent": "ordinal", "n1_chunks": "token_count n_blocks start_offset end_offset", "p9_lexical_search": "ordinal match_pos",
    "t3_lexical_display": "rank ordinal", "w4_surrounding": "centre ordinal n_chars", "p5_strip_html": "n_chars", "t1_library_order": "place", "w6_global_page": "spine_index",
    "w7_starting_page": "spine_index", "locations": "spine_index i char_offset", "w10_boundaries": "spine_index n", "w10_spine_of_location": "location spine_index",
    "cfi_generate": "spine_index", "v2_nearest": "rank", "v2_nearest_scoped": "rank", "a7_centroids": "i", "p12_body": "n_chars", "p12_self_closing": "n_chars", "v1_index_shape": "least most", "tool_semantic_search": "rank", "tool_semantic_search_scoped": "rank", "tool_lexical_search": "rank ordinal", "tool_surrounding_context": "ordinal n_chars", "s9_vector_index": "n_chars dim",
}
_CHUNKS = SQL["n1_chunks"]
for _name, _columns in INTEGERS.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INT) AS {c}' for c in _columns.split())}) FROM ({SQL[_name]})"
SQL["l2_norms"] = SQL["l2_norms"].replace("1.0 AS unit", "CAST(1 AS DOUBLE) AS unit")
SQL |= {"v2_index_exact": SQL["v2_nearest"], "v2_index_scoped": SQL["v2_nearest_scoped"], "p9_indexed_search": SQL["p9_lexical_search"]}
#: Each book as one chapter: the recursion of n1 over the blocks of all its documents.
_BOOK = BLOCKS.replace("b AS (", "lines AS (", 1) + ", b AS (SELECT book_id, CAST(0 AS BIGINT) AS chapter_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_id, ordinal) - 1 AS ordinal, text FROM lines)"
SQL["n1_book_chunks"] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('ordinal', 'first_block', 'n_blocks'))}, CAST(token_count AS INT) AS token_count) FROM ({_CHUNKS.replace(BLOCKS, _BOOK).replace('e - s AS n_blocks', 's AS first_block, e - s AS n_blocks')})"
