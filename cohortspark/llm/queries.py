"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import (
    bpe,
    conversations,
    divergence,
    exact_dedup,
    language_id,
    licenses,
    packing,
    phrase_dedup,
    pii,
    quality,
    shingle_join,
    topk,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_exact_copies(table(spark, folder, "documents"))


ORACLES["op1_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


@query
def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.link_components(table(spark, folder, "documents"))


@query
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"))


# the general globs as LIKE patterns on host and path
ORACLES["op7_url_filter"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule, says, rule_host, rule_path) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'),
  ('com/de/', 'block', 'com', '/de/')),
fitting AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                       AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT p.page_id, host, path, rule,
       coalesce(says, CASE WHEN host = '' OR host LIKE '%casino%' OR host LIKE '%cheap-pills%'
         OR host LIKE '%spam%' OR host LIKE '%porn%' OR host LIKE '%xxx%'
         OR path LIKE '%/wp-login%' OR path LIKE '%/cgi-bin/%' OR path LIKE '%/cart/%'
         OR path LIKE '%/login%' OR path LIKE '%.exe' THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fitting f ON p.page_id = f.page_id
"""


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"),
                                tokenizer_path("piece_bpe_32k.model"))


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, folder, "documents"),
                                 tokenizer_path("byte_bpe_50k.json"), with_outputs=False)


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_dedup.repeated(table(spark, folder, "documents"))


@query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


# every kept term of every source, one row each, in place of levels and cells
ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
kc AS (SELECT c.* FROM c SEMI JOIN k USING (lang, term)),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS words
      FROM g LEFT JOIN kc USING (lang, source) GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (words + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (total + 5)) // (whole + 5 * v) AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN kc USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part
                                 ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, folder, "conversations")).drop("signature")


# the cheapest repair as a fold over each conversation's rows from its end, for the grammar's
# states b (nothing yet), s, u, a (after such a row); whole audits are compared as strings
_FOLD = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    [i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS entry),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':'
                                     || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS id
  FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, id), lambda c, x:
                  xor(c >> 8, entry[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END
           AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos
  FROM damaged),
placed AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         regexp_matches(text, '^[\x20\x09-\x0D]*$') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM ordered),
r AS (
  SELECT *, blank OR again AS gone, NOT (blank OR again) AND cut AS truncated,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS initial_before
  FROM placed),
ways AS (
  SELECT conv_id,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (initial_before IS NOT NULL
                          AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         list_reduce(list_prepend(END_NODE, list(ROW_NODE ORDER BY pos DESC)), lambda n, x: STEP) AS n
  FROM r GROUP BY conv_id),
audits AS (SELECT *, n.b.c AS cost, n.b.p AS audit FROM ways),
edits AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit,
         unnest(range(1, length(audit) + 1)) AS k
  FROM audits WHERE audit <> ''),
numbered AS (
  SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS row_at,
         sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS line
  FROM edits),
lines AS (
  SELECT e.conv_id, e.line, e.edit, r.role, CASE WHEN e.edit = 'I' THEN '' ELSE r.text END AS text,
         max((e.line = 1 AND e.edit = 'K' AND r.initial = 's')::INT)
           OVER (PARTITION BY e.conv_id) AS led
  FROM numbered e LEFT JOIN r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.row_at = r.pos
  WHERE e.edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (line - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || text, chr(10) ORDER BY line) AS repaired
  FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN audits a ON o.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
"""


def _repair_fold() -> str:
    """The fold's start, elements and step: a node holds cost c and audit p of each state."""
    after = {"b": "u", "s": "u", "u": "a", "a": "u"}
    takes = {"b": "su", "s": "u", "u": "a", "a": "u"}

    def node(ways: dict[str, str], symbol: str) -> str:
        return "{" + ", ".join(f"{s}: {w}" for s, w in ways.items()) + f", {symbol}}}"

    def way(cost: str, audit: str) -> str:
        return f"{{c: {cost}, p: {audit}}}"

    def inserted(ways: dict[str, str]) -> str:
        """With up to two inserts in front, the cheapest and least of each state."""
        found = {}
        for s in after:
            options = [ways[s]]
            to, letters = s, ""
            for _ in range(2):
                to, letters = after[to], letters + "I"
                options.append(way(f"({ways[to]}).c + {3 * len(letters)}",
                                   f"'{letters}' || ({ways[to]}).p"))
            found[s] = f"list_sort([{', '.join(options)}])[1]"
        return found

    blank = "initial: '', gone: false, extra: 0::BIGINT"
    none = way("0::BIGINT", "''")
    start = {"b": none, "s": way("6::BIGINT", "'II'"), "u": way("3::BIGINT", "'I'"), "a": none}
    row = node(dict.fromkeys(after, none), "initial: initial, gone: gone,"
               " extra: CASE WHEN truncated THEN 3::BIGINT ELSE 0::BIGINT END")
    plain = {}
    for s in after:
        never = 1 << 60
        options = [way(f"n.{s}.c + 4", f"'D' || n.{s}.p"),
                   way(f"CASE WHEN x.gone THEN {never} ELSE n.{after[s]}.c + 3 + x.extra END",
                       f"'R' || n.{after[s]}.p")]
        options += [way(f"CASE WHEN x.gone OR x.initial <> '{i}' THEN {never}"
                        f" ELSE n.{i}.c + x.extra END", f"'K' || n.{i}.p") for i in takes[s]]
        plain[s] = f"list_sort([{', '.join(options)}])[1]"
    step = node(inserted(plain), blank)
    return (_FOLD.replace("END_NODE", node(start, blank)).replace("ROW_NODE", row)
            .replace("STEP", step))


ORACLES["op12_conversation_repair"] = _repair_fold()


@query
def op13_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


ORACLES["op13_topk_search"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS mark,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
found AS (
  SELECT q.mark, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.x, c.x),
                                          lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.mark <> c.mark),
ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (
    PARTITION BY mark ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank
  FROM found)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
