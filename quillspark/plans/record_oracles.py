"""SQL for the queries of quillspark.plans.record_queries, as DuckDB runs it on the same tables."""

from __future__ import annotations

from quillspark.operators.tools import ROLE_TOOLS, TOOL_ARGUMENTS, role_tools
from quillspark.plans.oracles import _LAYOUT, _PAIRS, _SHOWN, _strip

_SPACED = rf"trim(regexp_replace({{c}}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


def _words(c: str) -> str:
    """The text's words joined by single spaces."""
    return _SPACED.format(c=c)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_SKILLS = f"""
i AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 's' || item_id ELSE 'Skill ' || item_id END AS name, CASE WHEN item_id % 4 IN (1, 2) THEN 'about ' || item_id ELSE '' END AS description,
  {_words('text')} AS line, 1 - item_id % 2 AS root_pos FROM benchmark),
c AS (SELECT *, CASE WHEN length(line) > 280 THEN substr(line, 1, 280) || '...' ELSE line END AS summary FROM i)"""

_MANIFESTS = f"""
m AS (SELECT item_id, 'm' || item_id AS skill_id, ['Beta', 'alpha', ''][item_id % 3 + 1] AS domain, {_words('text')} AS goal,
  CASE WHEN item_id % 4 > 0 THEN list_transform(range(item_id % 9), lambda k: 's' || k) ELSE [] END AS scope, item_id % 4 > 0 AS has_inputs,
  ['m1', 'm2'][1:item_id % 3] AS method FROM benchmark)"""

_ATTEMPT_ROWS = """
a AS (SELECT user_id % 40 AS task, (user_id // 40)::INT AS subtask_id, event_id AS node_id, event_type AS description, props AS result,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(value)::BIGINT END AS number, CASE event_type WHEN 'purchase' THEN 'complete' ELSE 'other' END AS decision FROM events)"""


def _middle(c: str, limit: int) -> str:
    return f"CASE WHEN length({c}) <= {limit} THEN {c} ELSE substr({c}, 1, {limit // 2}) || chr(10) || '... [truncated] ...' || chr(10) || right({c}, {limit // 2}) END"


SQL: dict[str, str] = {
    "workflow_match_paths": f"""WITH {_PAIRS},
s AS (SELECT *, 'item_' || item_id || '.yaml' AS path, n_overlap * 2 + n_overlap / n AS score FROM pairs WHERE n_overlap / n >= CASE WHEN n >= 5 THEN 0.25 ELSE 0.34 END)
SELECT doc_id, path, n_overlap, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, path) = 1""",
    "workflow_files": "SELECT 'item_' || item_id AS name, trim(text) AS goal, '[\"draft\",\"check\"]' AS stages, true AS has_raw FROM benchmark WHERE item_id % 5 <> 4 AND item_id % 7 <> 0",
    "skill_catalog": f"WITH {_SKILLS} SELECT name, description, summary, root_pos::INT AS root_pos, 's' || item_id AS folder FROM c",
    "skill_brief": f"""WITH {_SKILLS}
SELECT '[SKILL BRIEF]' || chr(10) || string_agg('- skill_name: ' || name || chr(10) || '  description: ' || coalesce(nullif(description, ''), summary), chr(10) ORDER BY lower(name), root_pos) AS brief FROM c""",
    "skill_load": "SELECT * FROM (VALUES (0, 'Skill 3', true), (1, 'Skill 1', true), (2, 'Skill 3', true), (3, 's4', true)) AS t(pos, name, has_title)",
    "manifest_files": f"""WITH {_MANIFESTS} SELECT skill_id, domain, goal, array_to_string(scope, ',') AS scope, CASE WHEN has_inputs THEN 'x' ELSE '' END AS inputs, 0 AS n_outputs,
array_to_string(method, ',') AS method FROM m""",
    "manifest_brief": f"""WITH {_MANIFESTS},
l AS (SELECT *, '- skill_id: ' || skill_id || CASE WHEN domain <> '' THEN chr(10) || '  domain: ' || domain ELSE '' END ||
  CASE WHEN goal <> '' THEN chr(10) || '  goal: ' || CASE WHEN length(goal) > 240 THEN substr(goal, 1, 237) || '...' ELSE goal END ELSE '' END ||
  CASE WHEN len(scope) > 0 THEN chr(10) || '  scope:' || chr(10) || array_to_string(list_transform(scope[1:6], lambda x: '    - ' || x), chr(10)) ELSE '' END AS line FROM m)
SELECT '[SKILL MANIFESTS]' || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY lower(domain), lower(skill_id)) || chr(10) AS text FROM l""",
    "query_texts": "SELECT 'q' || item_id AS name, text FROM benchmark",
    "prompt_templates": "SELECT 'p' || item_id AS name, '# p' || item_id || chr(10) || 'Item ' || item_id || chr(10) || chr(10) || text AS prompt FROM benchmark",
    "node_folders": "SELECT turn AS node_id, conv_id, role FROM conversations",
    "contract_files": "SELECT doc_id, lang AS topic, CASE WHEN doc_id % 3 > 0 THEN source END AS domain, text AS task_description FROM documents",
    "summary_files": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id AS task, '# Summary' || chr(10) || chr(10) || '## Task' || chr(10) || 'conversation ' || conv_id || chr(10) || chr(10) || '## Trajectory' || chr(10) ||
string_agg(i || '. node=' || turn || ' subtask=' || turn || ' reward=1.0', chr(10) ORDER BY i) || chr(10) AS summary FROM t GROUP BY conv_id""",
    "contract_fields": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'plain ' || lang ELSE '{"topic":"' || lang || '","input":"' || source || '","subtasks":[' || doc_id || ']}' END AS contract FROM documents""",
    "viewer_nodes": f"""WITH {_LAYOUT},
t AS (SELECT p.*, repeat(text, 30) AS d, repeat(text, 300) AS o FROM p JOIN conversations USING (conv_id, turn))
SELECT conv_id AS task, turn AS node_id, parent_id, CASE WHEN turn > 1 THEN 'revise' ELSE 'draft' END AS node_type, md5({_middle('d', 4000)}) AS description, md5({_middle('o', 48000)}) AS output, '' AS memory,
CASE WHEN turn % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS reward, CASE WHEN role <> 'user' AND role <> '' THEN role ELSE 'said' END AS critic_feedback, viz_y FROM t""",
    "max_depths": "SELECT conv_id, (count(*) - 1)::INT AS max_depth FROM conversations GROUP BY conv_id",
    "completed_subtasks": f"""WITH {_ATTEMPT_ROWS},
b AS (SELECT * FROM a WHERE decision = 'complete' QUALIFY row_number() OVER (PARTITION BY task, subtask_id ORDER BY coalesce(number, 0) DESC, node_id) = 1)
SELECT task, (row_number() OVER (PARTITION BY task ORDER BY subtask_id) - 1)::INT AS place, subtask_id, description, result, coalesce(number::VARCHAR, 'nan') AS reward, '' AS log_path FROM b""",
    "node_records": f"""WITH {_ATTEMPT_ROWS}
SELECT task, node_id, CASE WHEN node_id % 3 = 0 THEN 7 ELSE row_number() OVER (PARTITION BY task ORDER BY node_id) END::INT AS depth, subtask_id, result, result AS theoretician_output, '' AS log_path,
0::DOUBLE AS reward, '' AS memory, '{{}}' AS evaluation FROM a""",
    "critic_inputs": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE '' END AS result,
CASE doc_id % 3 WHEN 0 THEN '{"analysis":"' || lang || '","code":"","files":["a.txt"]}' WHEN 1 THEN '{"analysis":"","code":"x = 1","files":[]}' ELSE '{"analysis":"","code":"","files":[]}' END AS context FROM documents""",
    "loop_fallbacks": """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN props WHEN event_id % 2 = 0 THEN '{"error":"' || event_type || '"}' ELSE '{"error":""}' END AS result,
CASE WHEN event_id % 3 > 0 THEN 'as asked' ELSE event_type END AS description FROM events""",
    "reply_variants": """WITH r AS (SELECT event_id, event_id % 4 AS k, json_extract_string(props, '$.k') AS n, props FROM events),
t AS (SELECT *, CASE k WHEN 0 THEN props WHEN 1 THEN 'text' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'The answer is ' || props || ' as asked.'
  ELSE '{broken ' || regexp_replace(props, '[{}]', '', 'g') END AS reply FROM r)
SELECT event_id, CASE WHEN k < 3 THEN '{"k": ' || n || '}' ELSE '{"raw_output": ' || to_json(reply) || ', "error": "no JSON object in the reply"}' END AS contract, CASE WHEN k < 3 THEN '{"k":' || n || '}' END AS viewer,
CASE WHEN k = 0 THEN '{"k":' || n || '}' ELSE '{"_raw":' || to_json(reply) || '}' END AS arguments, CASE WHEN k = 0 THEN '{"k":' || n || '}' END AS json, CASE WHEN k > 0 THEN reply END AS text FROM t""",
    "page_answers": """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '  ' || source || ' ' || chr(10) END AS content FROM documents)
SELECT doc_id, content, 0.5::DOUBLE AS score, content AS raw FROM a""",
    "clean_traces": """SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'Traceback (most recent call last):' || chr(10) ELSE '' END || 'ValueError: ' || source AS trace, source || chr(65533) || '(' AS decoded FROM documents""",
    "scope_brief": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN array_to_string(list_transform(range(6), lambda i: '    - ' || lang || i), chr(10)) WHEN 1 THEN '    - ' || source
WHEN 2 THEN '    - ' || doc_id ELSE '' END AS bullets FROM documents""",
    "tool_content": """SELECT event_id, 'do-' || event_type || '-now' AS tool, 'do_' || event_type || '_now' AS tool_key,
CASE event_type WHEN 'view' THEN props WHEN 'click' THEN 'pixels' WHEN 'signup' THEN event_type END AS content, CASE WHEN event_id % 2 = 0 THEN props END AS first FROM events""",
    "role_tools": f"SELECT * FROM (VALUES {_values([(r, t, i, ','.join(TOOL_ARGUMENTS[t][1])) for r in ROLE_TOOLS for i, t in enumerate(role_tools(r))])}) AS t(role, tool, pos, required)",
    "tool_lists": """WITH t AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'open' ELSE 'papers' END AS server, 'tool-' || page_id AS name FROM pages)
SELECT *, 0 AS list_pos FROM t WHERE server = 'open' UNION ALL SELECT *, 1 FROM t WHERE server = 'papers' AND name IN ('tool-1', 'tool-3') UNION ALL SELECT *, 2 FROM t WHERE name = 'tool-1'""",
    "tool_catalog": """SELECT * FROM (VALUES (0, 'a.py', 'python', 'read-a.py', 'read_a.py', 'reads'), (0, 'a.py', 'python', 'ask', 'ask', ''), (2, 'http://c', 'http', 'read-http', 'read_http', 'reads'),
(2, 'http://c', 'http', 'ask', 'ask', ''), (3, 'b.py', 'python', 'read-b.py', 'read_b.py', 'reads'), (3, 'b.py', 'python', 'ask', 'ask', '')) AS t(server_pos, server, kind, name, tool_key, description)""",
    "server_kinds": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'python' WHEN 2 THEN 'node' END AS kind FROM pages",
    "settings_file": """SELECT * FROM (VALUES ('model', '"m 1"'), ('rounds', '10'), ('library', '{"used":true}'), ('roots', '["a","b"]'), ('empty', 'null')) AS t(key, value)""",
    "stored_contracts": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stored ' || text ELSE lang END AS contract FROM documents",
    "session_lookup": """WITH live AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0)
SELECT event_id, user_id AS conv_id, CASE WHEN l.conv_id IS NOT NULL THEN 'live' ELSE 'created' END AS on_demand, CASE WHEN l.conv_id IS NOT NULL THEN 'live' ELSE 'missing' END AS status
FROM events LEFT JOIN live l ON l.conv_id = user_id""",
    "merged_records": """SELECT event_id, event_type AS type, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE user_id::VARCHAR END AS user, 'm' AS mode, CASE WHEN event_id % 2 = 0 THEN 4 ELSE 3 END AS n FROM events""",
    "elapsed": "SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6::DOUBLE AS seconds FROM events",
    "retried_replies": "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN 're: ' || source || ' ' || doc_id END AS reply FROM documents",
    "model_fallback": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'first ' || doc_id WHEN doc_id % 2 <> 0 THEN 'second ' || doc_id ELSE 'failed' END AS reply FROM documents",
    "replayed_replies": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'answer ' || doc_id END AS reply, sha256('ask ' || doc_id) AS prompt_key FROM documents",
    "model_settings": "SELECT doc_id, source AS model, min(n_chars) OVER (PARTITION BY source) AS window FROM documents",
    "tool_loops": """WITH u AS (SELECT doc_id, length(source || lang || left(doc_id::VARCHAR, 2)) AS n FROM documents)
SELECT doc_id, CASE n % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'done | ' || n WHEN 2 THEN 'done | ' || n || ' | tool missing is not implemented' ELSE 'step 2' END AS answer FROM u""",
    "prior_filtered": """WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e, 's' || label AS source_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, (vec_id % 4) || '.' || (vec_id % 5) AS section, 'Chunk ' || vec_id AS text FROM embeddings),
f AS (SELECT * FROM c WHERE source_id IN ('s1', 's2', 's3') AND section LIKE '2.%' AND (lower(text) LIKE '%chunk 1%' OR lower(text) LIKE '%chunk 2%' OR lower(text) LIKE '%chunk 3%')),
h AS (SELECT q.vec_id AS query, f.*, list_cosine_similarity(q.e, f.e) AS s FROM c q, f WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM h QUALIFY rank <= 3),
x AS (SELECT t.query, t.rank, t.source_id, t.section, string_agg(c.text, chr(10) ORDER BY c.pos) AS text FROM t JOIN c ON c.source_id = t.source_id AND c.pos BETWEEN t.pos - 1 AND t.pos + 1 GROUP BY ALL)
SELECT query, string_agg('[' || rank || '] ' || source_id || ' ' || section || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS answer FROM x GROUP BY query""",
    "fetch_fallback": f"""SELECT page_id, 'html' AS route, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 > 0 THEN {_SHOWN} ELSE 'scraped ' || page_id END AS page_text FROM pages""",
    "pdf_pages": f"SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN {_strip('(source || text)')} END AS page_text FROM documents",
    "token_windows": """WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text <> ''),
p AS (SELECT doc_id, t, unnest(range(0, ceil(len(t) / 100)::BIGINT)) AS pos FROM w) SELECT doc_id, pos, array_to_string(t[pos * 100 + 1:pos * 100 + 100], ' ') AS chunk FROM p""",
    "stream_items": """WITH e AS (SELECT *, event_id % 5 AS k FROM events)
SELECT event_id, CASE k WHEN 1 THEN 'tool_call' WHEN 2 THEN 'tool_result' WHEN 3 THEN 'code_result' ELSE 'session' END AS main_stream_type, CASE k WHEN 2 THEN 'tool' ELSE '' END AS sub_stream_type,
CASE k WHEN 1 THEN event_type WHEN 2 THEN props WHEN 3 THEN props ELSE '' END AS content, k IN (1, 2, 3) AS from_sandbox, CASE k WHEN 2 THEN 'end' WHEN 4 THEN 'end' WHEN 3 THEN 'running' ELSE 'start' END AS stream_state,
k = 4 AS terminal FROM e""",
    "session_state": """WITH r AS (SELECT *, role = 'system' OR turn % 4 = 3 AS reset FROM conversations),
g AS (SELECT *, sum(reset::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM r),
e AS (SELECT *, coalesce(max((role = 'assistant')::INT) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM g)
SELECT conv_id, turn, text FROM e WHERE NOT reset AND ended = 0""",
    "stream_poll": "SELECT conv_id::VARCHAR AS session_id, turn, role, 1::BIGINT AS n_read FROM conversations",
    "subtask_repair": """WITH RECURSIVE e AS (SELECT user_id || '-' || (event_id // 1000) AS task, event_id AS pos, CASE WHEN event_id % 4 > 0 THEN floor(value % 9)::INT END AS id,
  CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS description FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY pos) AS i FROM e),
w AS (SELECT task, pos, i, description, coalesce(id, 1) AS got, [coalesce(id, 1)] AS used, greatest(1, coalesce(id, 1) + 1) AS following FROM n WHERE i = 1
  UNION ALL SELECT n.task, n.pos, n.i, n.description, CASE WHEN n.id IS NULL OR list_contains(used, n.id) THEN following ELSE n.id END AS got,
    list_append(used, CASE WHEN n.id IS NULL OR list_contains(used, n.id) THEN following ELSE n.id END),
    greatest(following, CASE WHEN n.id IS NULL OR list_contains(used, n.id) THEN following ELSE n.id END + 1) FROM w JOIN n ON n.task = w.task AND n.i = w.i + 1)
SELECT task, (row_number() OVER (PARTITION BY task ORDER BY got, pos) - 1)::INT AS place, pos, got AS id, CASE WHEN trim(description) = '' THEN 'Subtask ' || got ELSE description END AS description FROM w""",
    "viewer_payload": f"""WITH {_LAYOUT},
t AS (SELECT p.*, text FROM p JOIN conversations USING (conv_id, turn))
SELECT conv_id AS task, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS task_description, first_value(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS root_id, turn AS node_id, depth::INT AS depth,
  role AS critic_feedback, md5({_middle('text', 4000)}) AS description, viz_y, count(*) OVER (PARTITION BY conv_id) - 1 AS n_edges FROM t""",
}
