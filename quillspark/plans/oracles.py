"""SQL for the queries of quillspark.plans.queries, as DuckDB runs it on the same tables."""

from __future__ import annotations

from quillspark.functions.text import HIDDEN_ELEMENTS, STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = r"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]+')"


def _content(c: str) -> str:
    return f"list_filter({_TOKENS.format(c=c)}, lambda t: t NOT IN ({_STOP}))"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _one_line(c: str) -> str:
    return rf"regexp_replace({_strip(c)}, '\s+', ' ', 'g')"


_PAIRS = f"""
q AS (SELECT doc_id, unnest(list_distinct({_content('text')})) AS t FROM documents),
g0 AS (SELECT item_id, {_content('text')} AS ts FROM benchmark),
g AS (SELECT item_id, len(ts) AS n, unnest(list_distinct(ts)) AS t FROM g0),
pairs AS (SELECT doc_id, item_id, n, count(*) AS n_overlap FROM q JOIN g USING (t) GROUP BY ALL)"""

_HTML = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _name in HIDDEN_ELEMENTS:
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_name}\b[^>]*>.*?</{_name}\s*>', chr(10), 'g')"
_HTML = f"regexp_replace({_HTML}, '(?s)<[^>]*>', chr(10), 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_char}')"
_SHOWN = f"array_to_string(list_filter(list_transform(string_split({_HTML}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10))"

_LAYOUT = """
c AS (SELECT conv_id, turn, role, row_number() OVER w - 1 AS depth, lag(turn) OVER w AS parent_id, lead(turn) OVER w AS child_id, count(*) OVER (PARTITION BY conv_id) - 1 AS last
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, 0.5::DOUBLE AS viz_x, round(CASE WHEN last = 0 THEN 0.5::DOUBLE ELSE 0.08::DOUBLE + 0.84::DOUBLE * (depth / last) END, 9) AS viz_y FROM c)"""

_ATTEMPTS = """
log0 AS (SELECT user_id % 40 AS task, (user_id // 40)::INT AS subtask, event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'to_redraft' ELSE 'to_revise' END AS decision FROM events),
log AS (SELECT *, row_number() OVER (PARTITION BY task, subtask ORDER BY ts, event_id)::INT AS attempt FROM log0)"""

_REPLIES = r"""
r AS (SELECT event_id, props, event_id % 5 AS k FROM events)"""

SQL: dict[str, str] = {
    "workflow_match": f"""WITH {_PAIRS},
s AS (SELECT *, n_overlap * 2 + n_overlap / n AS score FROM pairs WHERE n_overlap / n >= CASE WHEN n >= 5 THEN 0.25 ELSE 0.34 END)
SELECT doc_id, item_id, n_overlap, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1""",
    "overlap_pairs": f"""WITH q AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format(c='text')})) AS t FROM documents),
g0 AS (SELECT item_id, {_TOKENS.format(c='text')} AS ts FROM benchmark), g AS (SELECT item_id, len(ts) AS n, unnest(list_distinct(ts)) AS t FROM g0),
pairs AS (SELECT doc_id, item_id, n AS n_goal, count(*) AS n_overlap FROM q JOIN g USING (t) GROUP BY ALL)
SELECT doc_id, item_id, n_overlap, n_goal FROM pairs WHERE n_overlap / n_goal >= CASE WHEN n_goal >= 5 THEN 0.25 ELSE 0.34 END""",
    "tokenize_counts": f"SELECT doc_id, len({_TOKENS.format(c='text')}) AS n_tokens, len({_content('text')}) AS n_content FROM documents",
    "search_topk": f"""WITH {_PAIRS.replace('doc_id, item_id, n, count', 'item_id, doc_id, n, count')}
SELECT item_id, doc_id, n_overlap, row_number() OVER (PARTITION BY item_id ORDER BY n_overlap DESC, doc_id)::INT AS rank FROM pairs QUALIFY rank <= 10""",
    "best_attempt": """SELECT user_id, event_id, round(value, 0) AS reward FROM events WHERE event_type = 'purchase'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value, 0) DESC, ts, event_id) = 1""",
    "refine_replay": f"""WITH {_ATTEMPTS},
c AS (SELECT *, coalesce(max((decision = 'complete')::INT) OVER (PARTITION BY task, subtask ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
  max((decision = 'complete')::INT) OVER (PARTITION BY task, subtask) AS done,
  lag(decision) OVER (PARTITION BY task, subtask ORDER BY attempt) AS before FROM log),
b AS (SELECT *, coalesce(min(done) OVER (PARTITION BY task ORDER BY subtask RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS open FROM c WHERE stopped = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY subtask, attempt)::INT AS round FROM b WHERE open = 1)
SELECT task, subtask, attempt, event_id, decision, round, CASE WHEN before IS NULL OR before = 'to_redraft' THEN 'draft' ELSE 'revise' END AS node_type FROM n WHERE round <= 6""",
    "path_memory": f"""SELECT conv_id, turn, coalesce(string_agg(nullif({_strip('text')}, ''), chr(10)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS memory,
coalesce(string_agg(nullif({_strip('text')}, ''), chr(10)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS given
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "chain_graph": f"WITH {_LAYOUT} SELECT conv_id, turn, depth::INT AS depth, parent_id, child_id, viz_x, viz_y FROM p",
    "edge_semi": f"""WITH {_LAYOUT}
SELECT a.conv_id, a.turn AS src, a.child_id AS dst, a.viz_y AS src_y, b.viz_y AS dst_y FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.child_id = b.turn WHERE a.role <> 'system' AND b.role <> 'system'""",
    "sibling_layout": """WITH d AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS depth FROM conversations)
SELECT conv_id, turn, depth, round(row_number() OVER (PARTITION BY conv_id, depth ORDER BY turn) / (count(*) OVER (PARTITION BY conv_id, depth) + 1), 9) AS viz_x,
round(0.12::DOUBLE + 0.16::DOUBLE * depth, 9) AS viz_y FROM d""",
    "shorten": f"""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 200) || chr(10) || '... [truncated] ...' || chr(10) || right(text, 200) END AS middle,
CASE WHEN length(l) > 280 THEN substr(l, 1, 280) || '...' ELSE l END AS summary, CASE WHEN length(l) > 240 THEN substr(l, 1, 237) || '...' ELSE l END AS goal
FROM (SELECT doc_id, text, {_one_line('text')} AS l FROM documents)""",
    "clean_text": rf"""SELECT doc_id, {_strip("(chr(10) || chr(10) || chr(9) || ' ' || text || ' ' || chr(10))")} AS stripped, regexp_replace(text, '[^\p{{L}}\p{{N}}._-]', '_', 'g') AS name,
lang AS thought, CASE WHEN lang <> 'en' AND lang <> '' THEN lang ELSE source END AS filled, '{{' || lang || '}} from ' || source AS filled_template FROM documents""",
    "chunk_documents": "SELECT doc_id, pos, substr(text, pos * 500 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 500)::BIGINT)) AS pos FROM documents WHERE length(text) > 0)",
    "first_chunks": "SELECT doc_id, nullif(substr(text, 1, 20000), '') AS chunk FROM documents",
    "html_text": f"SELECT page_id, {_SHOWN} AS shown FROM pages",
    "html_text_sql": f"SELECT page_id, {_SHOWN} AS shown FROM pages",
    "extract_json": f"WITH {_REPLIES} SELECT event_id, CASE WHEN k = 4 THEN '{{}}' ELSE json(props)::VARCHAR END AS value FROM r",
    "extract_json_native": f"WITH {_REPLIES} SELECT event_id, CASE WHEN k = 4 THEN '{{}}' ELSE json(props)::VARCHAR END AS value FROM r",
    "decision_normalize": """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <= 2 THEN NULL ELSE floor(value)::BIGINT END AS r FROM events),
x AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'to_redraft' ELSE 'to_revise' END AS decision, coalesce(r, 0)::DOUBLE AS reward,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE r::INT END AS whole FROM e)
SELECT *, CASE decision WHEN 'complete' THEN 'accept' WHEN 'to_revise' THEN 'refine' ELSE 'reject' END AS verdict, CASE decision WHEN 'to_redraft' THEN 'draft' ELSE 'revise' END AS node_type FROM x""",
    "session_partition": """WITH d AS (SELECT DISTINCT conv_id, md5(conv_id::VARCHAR) AS m FROM conversations)
SELECT conv_id, (((('0x' || substr(m, 1, 16))::UBIGINT % 7) * (18446744073709551616::HUGEINT % 7) + ('0x' || substr(m, 17, 16))::UBIGINT % 7) % 7)::INT AS part FROM d""",
    "take_until_terminal": """SELECT user_id, event_id, event_type FROM events
QUALIFY coalesce(max((event_type = 'purchase' AND event_id % 2 = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""",
    "session_stream": """SELECT conv_id, turn, text FROM conversations
QUALIFY coalesce(max((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""",
    "first_and_last": """SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, 'first' AS which FROM documents GROUP BY source
UNION ALL SELECT source, max(doc_id), arg_max(lang, doc_id), 'last' FROM documents GROUP BY source""",
    "duplicate_texts": """SELECT md5(text) AS key, min(doc_id) OVER (PARTITION BY md5(text)) AS first_path, doc_id AS dup_path FROM documents
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1""",
    "catalog_lookup": "SELECT doc_id, quality, toxic, source, n_chars FROM labels JOIN documents USING (doc_id)",
    "catalog_missing": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "tool_results": """SELECT event_id, event_type AS tool, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'clicked' WHEN 'signup' THEN 'joined'
ELSE 'tool ' || event_type || ' is not implemented' END AS result FROM events""",
    "prior_topk": """WITH h AS (SELECT q.vec_id AS query, c.vec_id AS chunk, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.label <> 0),
t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, chunk) <= 4)
SELECT query, chunk, round(s, 6) AS similarity FROM t WHERE query <> chunk""",
    "expand_context": """SELECT h.conv_id, h.turn, c.turn AS seq FROM conversations h JOIN conversations c ON h.conv_id = c.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 WHERE h.role = 'system'""",
    "running_cap": """SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents QUALIFY before < 20000""",
    "fetch_route": r"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '.pdf' WHEN 1 THEN 'https://arxiv.org/abs/' || page_id ELSE url END AS url, html FROM pages)
SELECT page_id, CASE WHEN contains(url, '.pdf') OR regexp_matches(url, 'arxiv\.org/(abs|pdf)/') THEN 'pdf' ELSE 'html' END AS route, lower(url) LIKE '%.pdf' OR starts_with(ltrim(html), '%PDF') AS pdf,
replace(url, 'arxiv.org/abs/', 'arxiv.org/pdf/') AS fetched, regexp_replace(string_split(url, '/')[-1], '(.)\.[^.]*$', '\1') AS stem FROM p""",
    "ndjson_ingest": """SELECT CASE WHEN (conv_id + turn) % 10 <> 0 THEN role END AS role, (conv_id + turn) % 10 = 0 AS bad, count(*) AS n FROM conversations GROUP BY ALL""",
    "format_hits": f"""WITH {_PAIRS},
t AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_overlap DESC, doc_id) AS rank FROM pairs QUALIFY rank <= 10)
SELECT item_id, string_agg(rank || '. doc ' || doc_id || chr(10) || 'URL: ' || source || chr(10) || text, chr(10) ORDER BY rank) AS block FROM t JOIN documents USING (doc_id) GROUP BY item_id""",
    "flatten_text": "SELECT event_id, 'type: ' || event_type || '; items: a ' || event_id || '; who: user: ' || user_id AS flat FROM events",
    "last_assistant": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND trim(coalesce(text, '')) <> '' GROUP BY conv_id",
    "contract_subtasks": """WITH d AS (SELECT doc_id, source, lang, doc_id % 4 AS k FROM documents)
SELECT doc_id, 0 AS pos, 7 AS id, source AS description, 'reasoning' AS subtask_type, 'in' AS input FROM d WHERE k = 0
UNION ALL SELECT doc_id, 1, NULL, lang, 'reasoning', 'in' FROM d WHERE k = 0
UNION ALL SELECT doc_id, 0, 2, lang, 'reasoning', 'in' FROM d WHERE k = 1
UNION ALL SELECT doc_id, 0, NULL, 'one', 'reasoning', 'in' FROM d WHERE k = 2
UNION ALL SELECT doc_id, 1, NULL, source, 'reasoning', 'in' FROM d WHERE k = 2
UNION ALL SELECT doc_id, 0, 1, source, 'reasoning', 'in' FROM d WHERE k = 3""",
    "parse_pages": r"""SELECT page_id, CASE WHEN contains(url, '.pdf') OR regexp_matches(url, 'arxiv\.org/(abs|pdf)/') THEN 'pdf' ELSE 'html' END AS route,
CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 2 = 0 THEN 'plain' ELSE 'c' END AS content, CASE WHEN page_id % 3 = 0 OR page_id % 2 = 0 THEN 0 ELSE 1 END AS n_urls,
CASE WHEN page_id % 3 = 0 THEN -1.0 WHEN page_id % 2 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS score FROM pages""",
    "search_envelopes": """WITH d AS (SELECT doc_id, source, lang, doc_id % 2 AS k FROM documents)
SELECT doc_id, 0 AS rank, 'a' || source AS title, lang AS link, 'a' AS text FROM d WHERE k = 0
UNION ALL SELECT doc_id, 1, 'b' || source, lang, 'b' FROM d WHERE k = 0 UNION ALL SELECT doc_id, 1, 'a' || source, lang, 'a' FROM d WHERE k = 1""",
    "fallback_summaries": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id AS task, '# Summary' || chr(10) || chr(10) || '## Task' || chr(10) || 'conversation ' || conv_id || chr(10) || chr(10) || '## Trajectory' || chr(10) ||
string_agg(i || '. node=' || turn || ' subtask=' || turn || ' reward=0.5' || chr(10) || '   - ' || role, chr(10) ORDER BY i) || chr(10) AS summary FROM t GROUP BY conv_id""",
}
