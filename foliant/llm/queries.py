"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, html, langid, media, negatives, packing, secrets, simhash, tokens, turns, urlfilter, warc
from .common import rows_of


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine; executors have the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str, pieces: str | None = None) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.fold() != 2), pieces or vocabulary("piece_bpe_32k.model"))
    return langid.identify(docs, model).select("doc_id", (langid.fold() == 2).alias("held_out"), "lang_pred", "score")


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judge_urls(rows_of(spark, sf_dir, "pages", "page_id", "url"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def _term(term: str) -> str:
    return rf"regexp_matches(u, '(^|\P{{L}}){term}(\P{{L}}|$)')"


OP2_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
    {" OR ".join(map(_term, urlfilter.STRICT))} AS strict,
    {" + ".join(f"CAST({_term(t)} AS INT)" for t in urlfilter.SOFT)} AS soft,
    {" + ".join(f"{w} * CAST({_term(t)} AS INT)" for t, w in urlfilter.SOFT.items())} AS weight
  FROM parts)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
       ELSE CASE WHEN strict OR (soft >= 2 AND weight >= {urlfilter.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(rows_of(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN t USING (payload_digest)
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(rows_of(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(rows_of(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(rows_of(spark, sf_dir, "documents", "doc_id", "text"), rows_of(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM items, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS g(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM docs, lengths, unnest(generate_series(1, len(w) - n + 1)) AS g(i)),
found AS (SELECT DISTINCT r, s.n, i, item_id FROM spots s JOIN windows v ON s.n = v.n AND s.win = v.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(generate_series(i, i + n - 1)) AS g(p) GROUP BY r),
which AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN which USING (r)
"""


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(rows_of(spark, sf_dir, "documents", "doc_id", "text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(rows_of(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return tokens.count_tokens(rows_of(spark, sf_dir, "documents", "doc_id", "text"), path or vocabulary("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return packing.pack(rows_of(spark, sf_dir, "documents", "doc_id", "text"), path or vocabulary("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows_of(spark, sf_dir, "embeddings", F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.mine(rows, F.col("id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(rows_of(spark, sf_dir, "documents", "doc_id", "text"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(rows_of(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


#: The programme of op13 backwards in a recursion: of each state the cheapest {cost, audit, lines}, compared in that order.
_OPTION = "{{'c': {cost}, 'a': '{op}' || {of}.a, 'r': {line} || {of}.r}}"
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def _state(q: int) -> str:
    role = {2: "user", 3: "assistant"}[_NEXT[q]]
    keep = {0: "CASE code WHEN 'u' THEN b2 WHEN 's' THEN b1 END", 2: "CASE code WHEN 'a' THEN b3 END"}.get(q, "CASE code WHEN 'u' THEN b2 END")
    stay = "CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END"
    kept = _OPTION.format(cost=f"({keep}).c + {stay}", op="K", of=f"({keep})", line="chr(10) || role || ':' || text")
    kept = f"CASE WHEN ({keep}) IS NULL THEN {{'c': 1000000000, 'a': '', 'r': ''}} ELSE {kept} END"
    rerole = _OPTION.format(cost=f"b{_NEXT[q]}.c + 1 + {stay}", op="R", of=f"b{_NEXT[q]}", line=f"chr(10) || '{role}:' || text")
    return f"list_min([{_OPTION.format(cost=f'b{q}.c + 2', op='D', of=f'b{q}', line="''")}, {kept}, {rerole}]) AS n{q}"


def _inserted(q: int) -> str:
    one, two = _NEXT[q], _NEXT[_NEXT[q]]
    line = {2: "chr(10) || 'user:'", 3: "chr(10) || 'assistant:'"}
    return f"list_min([n{q}, {_OPTION.format(cost=f'n{one}.c + 5', op='I', of=f'n{one}', line=line[one])}, {_OPTION.format(cost=f'n{two}.c + 10', op='II', of=f'n{two}', line=f'{line[one]} || {line[two]}')}]) AS b{q}"


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BITS = "flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: list_transform(range(8), lambda i: (ord(c) >> i) & 1)))"
OP13_SQL = f"""
WITH RECURSIVE cases AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, {_BITS}), lambda acc, b: xor(acc >> 1, 3988292384 * (xor(acc, b) & 1))), 4294967295) % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM cases, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS t, left(role, 1) AS code, rtrim(text, {_WHITE}) AS body FROM damaged),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY t) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lead(code) OVER (PARTITION BY conv_id ORDER BY t) AS following
  FROM placed),
told AS (
  SELECT conv_id, max(t) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (code || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
least AS (
  SELECT conv_id, n AS t, {", ".join(map(_inserted, range(4)))}
  FROM (SELECT conv_id, n, {", ".join(f"{{'c': {0 if q in (0, 3) else 1000000000}, 'a': '', 'r': ''}} AS n{q}" for q in range(4))} FROM told)
  UNION ALL
  SELECT conv_id, t, {", ".join(map(_inserted, range(4)))}
  FROM (SELECT l.conv_id, l.t - 1 AS t, {", ".join(map(_state, range(4)))} FROM least l JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.t = l.t))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b0.c, 0) AS BIGINT) AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(substr(b0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN least ON least.conv_id IS NOT DISTINCT FROM c.conv_id AND least.t = 0
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_language_id, op2_url_filter, op3_warc, op4_secrets, op5_simhash, op6_decontamination, op7_media, op8_html_extraction, op9_token_counts, op10_packing, op11_hard_negatives, op12_exact_dedup, op13_turns]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op3_warc": OP3_SQL, "op6_decontamination": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_turns": OP13_SQL}
