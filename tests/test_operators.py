"""Rules of single operators on hand-made edge rows, against plain Python where SQL has no form."""

import json
import math
import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.functions import jsonx, text
from quillspark.operators import catalog, contracts, graphs, matching, records, refine, tools
from quillspark.scratch import shared_root
from quillspark.sources import external, files
from quillspark.streaming import sessions


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given,want", [("Kernel_1 物理 é", ["kernel_1", "物理"]), ("", []), (None, []), ("cafés", ["caf", "s"]), ("a-b_c", ["a", "b_c"])])
def test_tokenize(spark, given, want):
    assert one(spark, text.tokenize("t"), t=given) == want


def test_stopwords_keep_repeats(spark):
    assert one(spark, text.content_tokens("t"), t="the beam the beam of") == ["beam", "beam"]


@pytest.mark.parametrize("given,want", [("a😀b", "a😀b"), ("x" * 10, "x" * 10), ("abcdefghijkl", "abcde\n... [truncated] ...\nhijkl")])
def test_shorten_middle(spark, given, want):
    assert one(spark, text.shorten_middle("t", 10), t=given) == want


def test_tails(spark):
    assert len(one(spark, text.summary_line("t"), t="x" * 300)) == 283
    assert len(one(spark, text.goal_line("t"), t="x" * 300)) == 240
    assert one(spark, text.goal_line("t"), t="x" * 240) == "x" * 240
    assert one(spark, text.summary_line("t"), t=" a \n b\t c ") == "a b c"


CARD = "---\nname: 'Beam Theory'\ndescription: bends\n---\n\n# Title\n\nFirst real\nparagraph.\n\nMore"


def test_front_matter(spark):
    assert one(spark, text.front_matter_value("t", "name"), t=CARD) == "Beam Theory"
    assert one(spark, text.front_matter_value("t", "name"), t="no front") is None
    assert one(spark, text.front_matter_value("t", "name"), t="---\nname: x") is None
    assert one(spark, text.first_paragraph(text.without_front_matter("t")), t=CARD) == "First real paragraph."
    assert one(spark, text.first_paragraph(text.without_front_matter("t")), t="# Only a heading") == ""


@pytest.mark.parametrize("page,want", [
    ("<p>a <b>bold</b> c</p>", "a\nbold\nc"), ("<head><title>T</title></head><header>no</header><p>yes</p>", "T\nyes"),
    ("<script>'</p>'</script><p>x</p><!-- gone -->", "x"), ("<nav>a<div>b</div></nav>c&amp;d", "c&d"), ("", ""), ("<p>open", "open"), ("a</nav>b", "a\nb"),
])
def test_html(spark, page, want):
    assert text.html_text(page) == want
    assert one(spark, text.html_to_text("t"), t=page) == want


@pytest.mark.parametrize("page,want", [
    ("<title>a&amp</title><p>&quot;b&quot</p>", 'a&amp\n"b&quot'), ("<p>&amp;&am &a&lt b&</p>", "&&am &a&lt b&"), ("<script>&amp</script><p>&#39;&#39 &amp;amp;</p>", "'&#39 &amp;"), ("&notit;&", "&notit;&"),
])
def test_html_with_unclosed_references(spark, page, want):
    assert text.html_text(page, unclosed=False) == want
    assert one(spark, text.html_to_text("t", unclosed=False), t=page) == one(spark, text.html_to_text_sql("t"), t=page) == want
    assert text.html_text("<p>a&amp b&lt</p>") == "a& b<"  # as the parser of the reference has it


def test_html_null():
    assert text.html_text(None) is None


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "id int, t string")
    assert [(r["id"], r["pos"], r["chunk"]) for r in text.chunk_characters(df, "t", 3).orderBy("pos").collect()] == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g")]
    words = text.chunk_tokens(df, "t", 2, lambda t: list(t), "".join).orderBy("pos").collect()
    assert [r["chunk"] for r in words] == ["ab", "cd", "ef", "g"]
    assert (text.chunk_size("my-QWEN-7"), text.chunk_size("deepseek"), text.chunk_size(None)) == (6000, 12000, 8000)


def test_hash_partition(spark):
    import hashlib

    for key in ("", "1", "session-é"):
        for n in (1, 7, 1000):
            assert one(spark, text.hash_partition("t", n), t=key) == int(hashlib.md5(key.encode()).hexdigest(), 16) % n


def test_names_and_addresses(spark):
    assert one(spark, text.safe_name("t"), t="a b/é-物.1") == "a_b_é-物.1"
    assert one(spark, text.arxiv_pdf("t"), t="https://arxiv.org/abs/1.2") == "https://arxiv.org/pdf/1.2"
    assert one(spark, text.file_stem("t"), t="/a/b.c.txt") == "b.c"
    assert one(spark, text.strip("t"), t="\n\t a b \n") == "a b"
    assert one(spark, text.fill_template("{{{a}}} {b}", a="a", b="b"), a="x", b=None) == "{x} "


REPLIES = ['{"a":1}', 'x\n```json\n{"a": 2}\n```', '```\nbroken\n```\n```json\n[1]\n```', 'so {"a": 3} done', "list [1, 2] end", "nothing", "", '{"a":1}{"b":2}', "null", '{"a": NaN}', "[{]", '{"é": "物"}']


@pytest.mark.parametrize("reply,want", list(zip(REPLIES, ['{"a":1}', '{"a":2}', "[1]", '{"a":3}', "[1,2]", "{}", "{}", "{}", "null", '{"a":NaN}', "{}", '{"é":"物"}'])))
def test_extract_json(spark, reply, want):
    assert one(spark, jsonx.extract_json("t"), t=reply) == want


def test_extract_json_variants(spark):
    assert one(spark, jsonx.extract_json("t", arrays=False, every_fence=False, otherwise=None), t="[1] and ```\nx\n``` ```\n{}\n```") == "{}"
    assert json.loads(one(spark, jsonx.extract_contract("t"), t="no"))["raw_output"] == "no"
    assert one(spark, jsonx.tool_arguments("t"), t="oops") == '{"_raw":"oops"}'
    assert one(spark, jsonx.tool_arguments("t"), t="") == "{}"
    got = one(spark, jsonx.parse_page_answer("t"), t=r'a {"content": "\(x\)", "score": "bad", "urls": [1, {"url": "u"}]} b')
    assert (got["content"], got["score"], [u["url"] for u in got["urls"]]) == (r"\(x\)", 0.0, ["u"])


@pytest.mark.parametrize("value,want", [(None, ""), (" a ", "a"), ([" a", "", ["b"]], "a b"), ({"k": "v", "e": "", "n": {"m": [1, 2]}}, "k: v; n: m: 1 2"), (0, "0"), (False, "False")])
def test_flatten(spark, value, want):
    assert jsonx.flatten(value) == want
    if not isinstance(value, str):
        assert one(spark, jsonx.flatten_json("t"), t=json.dumps(value)) == want


@pytest.mark.parametrize("given,want", [("0.5", 0.5), ("nan", 0.0), (None, 0.0), ("x", 0.0), ("1e3", 1000.0)])
def test_reward(spark, given, want):
    assert one(spark, jsonx.to_reward(F.col("t")), t=given) == want


def test_decisions(spark):
    assert [one(spark, jsonx.to_decision(F.col("t")), t=t) for t in (" Complete\n", "TO_REDRAFT", "what", None)] == ["complete", "to_redraft", "to_revise", "to_revise"]
    assert one(spark, jsonx.to_verdict(F.lit("to_redraft"), F.col("t")), t="") == "reject"


def repair(ids):
    used, following, out = set(), 1, []
    for x in ids:
        x = following if x is None or x in used else x
        used.add(x)
        following = max(following, x + 1)
        out.append(x)
    return out


def test_repaired_ids(spark):
    rng = random.Random(1)
    lists = [[rng.choice([None, 1, 2, 3, 7, -2]) for _ in range(rng.randint(0, 9))] for _ in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>")
    got = {r["i"]: r["x"] for r in df.select("i", contracts.repaired_ids(F.col("ids")).alias("x")).collect()}
    assert got == {i: repair(x) for i, x in enumerate(lists)}


def test_subtask_shapes(spark):
    given = [
        (1, '{"subtasks": [{"id": "2", "name": " n ", "input": null}, "text"], "input": "i", "x": 1}'), (2, '{"sub-tasks": {"a": {"objective": "o", "subtask_type": " "}}}'),
        (3, '{"sub_tasks": "only"}'), (4, '{"task_description": "whole"}'), (5, "broken"), (6, '{"sub-tasks": [], "subtasks": ["x"]}'),
    ]
    df = spark.createDataFrame(given, "k int, c string")
    got = [(r["task"], r["id"], r["description"], r["subtask_type"], r["input"]) for r in contracts.normalize_subtasks(df, "k", "c").orderBy("task", "pos").collect()]
    assert got == [(1, 2, "n", "reasoning", None), (1, None, "text", "reasoning", "i"), (2, None, "o", "reasoning", ""), (3, None, "only", "reasoning", ""), (4, 1, "whole", "reasoning", ""),
                   (5, 1, "", "reasoning", ""), (6, None, "x", "reasoning", "")]
    fixed = contracts.repair_subtasks(contracts.normalize_subtasks(df, "k", "c")).orderBy("task", "pos").collect()
    assert [(r["task"], r["id"], r["description"]) for r in fixed][-2:] == [(5, 1, "Subtask 1"), (6, 1, "x")]
    kept = json.loads(one(spark, contracts.known_fields("c"), c=given[0][1]))
    assert set(kept) == {"subtasks", "input"} and kept["subtasks"][1] == "text"
    assert one(spark, contracts.known_fields("c"), c="[1]") == "[1]"


def loop(log, budget):
    ran, rounds = [], 0
    for st in sorted({x[0] for x in log}):
        done = False
        for a, d in sorted((x[1], x[2]) for x in log if x[0] == st):
            if rounds == budget:
                return ran
            rounds += 1
            ran.append((st, a))
            if d == "complete":
                done = True
                break
        if not done:
            return ran
    return ran


def test_replay(spark):
    rng = random.Random(2)
    tasks = {t: [(s, a, rng.choice(["complete", "to_revise", "to_redraft"])) for s in range(1, rng.randint(2, 5)) for a in range(1, rng.randint(2, 5))] for t in range(80)}
    df = spark.createDataFrame([(t, *x) for t, xs in tasks.items() for x in xs], "task int, subtask int, attempt int, decision string")
    got = {}
    for r in refine.replay(df, 6).orderBy("task", "round").collect():
        got.setdefault(r["task"], []).append((r["subtask"], r["attempt"]))
    assert got == {t: loop(xs, 6) for t, xs in tasks.items() if xs}


def test_live_loop_equals_replay(spark, tmp_path):
    verdict = {(1, 1): "to_revise", (1, 2): "complete", (2, 1): "complete", (3, 1): "to_redraft", (3, 2): "to_revise"}
    tasks = spark.createDataFrame([("t", s, f"d{s}") for s in (1, 2, 3)], "task string, subtask int, description string")
    decisions = spark.createDataFrame([(s, a, d) for (s, a), d in verdict.items()], "subtask int, attempt int, decision string")

    def store(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    solve = lambda df: df.withColumn("result", F.concat("description", F.lit("!")))
    critique = lambda df: df.join(decisions, ["subtask", "attempt"]).withColumn("reward", F.lit(1.0)).withColumn("summary", F.concat(F.lit("s"), F.col("round").cast("string")))
    log = refine.run_live(tasks, solve, critique, 5, store).orderBy("round").collect()
    assert [(r["subtask"], r["attempt"], r["node_type"], r["memory"]) for r in log] == [
        (1, 1, "draft", ""), (1, 2, "revise", "s1"), (2, 1, "draft", "s1\ns2"), (3, 1, "draft", "s1\ns2\ns3"), (3, 2, "draft", "s1\ns2\ns3\ns4")]


def test_best_attempt_ties_and_nan(spark):
    df = spark.createDataFrame([(1, 1, "1.0", "complete"), (1, 2, "1.0", "complete"), (1, 3, "nan", "complete"), (1, 4, "9", "to_revise"), (2, 5, None, "complete"), (3, 6, "1", "to_revise")], "s int, n int, r string, decision string")
    got = refine.best_attempts(df, ["s"], jsonx.to_reward(F.col("r")), [F.col("n")]).orderBy("s").collect()
    assert [(r["s"], r["n"]) for r in got] == [(1, 1), (2, 5)]


def test_records(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, n int, p string")
    assert [(r["k"], r["n"]) for r in records.first_wins(df, ["k"], [F.col("n")]).orderBy("k").collect()] == [("a", 1), ("b", 2)]
    assert [(r["k"], r["n"]) for r in records.last_wins(df, ["k"], [F.desc("n")]).orderBy("k").collect()] == [("a", 3), ("b", 2)]
    assert [tuple(r) for r in records.duplicates(df, "k", "p", [F.col("n")]).collect()] == [("a", "x", "z")]
    with pytest.raises(LookupError, match="c"):
        records.require_all(spark.createDataFrame([("a",), ("c",)], "k string"), df, "k")
    ends = spark.createDataFrame([(1, 1, "running", ""), (1, 2, "end", "tool"), (1, 3, "end", None), (1, 4, "running", "")], "s int, n int, state string, sub string")
    assert [r["n"] for r in records.take_until(ends, ["s"], [F.col("n")], records.is_terminal(F.col("state"), F.col("sub"))).orderBy("n").collect()] == [1, 2, 3]
    kinds = spark.createDataFrame([("text", "t", "i", "r"), ("image", "t", "i", "r"), ("other", "t", "i", "r")], "k string, t string, i string, r string")
    assert [r[0] for r in kinds.select(records.content_text(*[F.col(c) for c in "ktir"])).collect()] == ["t", "i", None]


def test_routes(spark):
    route = lambda url, kind=None: one(spark, records.route_page(F.col("u"), F.col("c")), u=url, c=kind)
    assert [route("http://a/x.pdf"), route("http://a/x.PDF"), route("https://arxiv.org/abs/1"), route("http://a", "Application/PDF"), route(None)] == ["pdf", "html", "pdf", "pdf", "html"]
    assert one(spark, records.is_pdf(F.col("u"), F.col("b")), u="http://a/x.PDF", b=None) is True
    assert one(spark, records.is_pdf(F.col("u"), F.col("b")), u=None, b=" %PDF-1.4") is True


def test_graph_payload(spark):
    nodes = spark.createDataFrame([("t", 5, 1, "d1", None, "o" * 50000, "0.5", None, "", "crit"), ("t", 9, 1, None, "m", None, None, "revise", "ok", None)],
                                  "task string, node_id long, subtask_id int, description string, memory string, theoretician_output string, reward string, node_type string, evaluation string, critic_feedback string")
    chained = graphs.chain_layout(graphs.chain(nodes, ["task"], "node_id", "node_id"), ["task"], "node_id")
    tasks = spark.createDataFrame([("t", "what", None), ("empty", None, None)], "task string, task_description string, summary string")
    out = {r["task"]: json.loads(r["payload"]) for r in graphs.payload(graphs.viewer_nodes(chained), graphs.chain_edges(chained, ["task"], "node_id"), tasks).collect()}
    assert out["t"]["edges"] == [[5, 9]] and out["t"]["root_id"] == 5 and [n["viz_y"] for n in out["t"]["nodes"]] == pytest.approx([0.08, 0.92])
    first = out["t"]["nodes"][0]
    assert (first["critic_feedback"], first["reward"], first["node_type"], first["children"]) == ("crit", 0.5, "draft", [9]) and len(first["theoretician_output"]) < 50000
    assert out["empty"]["edges"] == [] and out["empty"]["root_id"] == 0
    page = files.report(json.dumps(out["t"] | {"summary": "</script>"}))
    assert page.count("</script>") == 1 and "PAYLOAD" not in page


def test_match_rules(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, "the of"), (3, "")], "id int, t string")
    g = spark.createDataFrame([(1, "alpha alpha alpha x"), (2, "alpha beta c d e"), (3, "alpha beta c d e"), (4, "")], "gid int, g string")
    got = matching.best_match(q, g, "id", "t", "gid", "g").collect()
    assert [(r["query"], r["goal"], r["n_overlap"]) for r in got] == [(1, 2, 2)]
    assert matching.overlaps(q, g, "id", "t", "gid", "g").where("goal = 1").first()["n_goal"] == 4


def test_catalog(spark, tmp_path):
    for name, body in (("one/a", CARD), ("one/b", "plain text"), ("two/c", CARD)):
        folder = tmp_path / name
        folder.mkdir(parents=True)
        (folder / "SKILL.md").write_text(body)
    cards = catalog.skills(spark, [str(tmp_path / "one"), str(tmp_path / "missing"), str(tmp_path / "two")])
    assert [(r["name"], r["root_pos"]) for r in catalog.in_order(cards).collect()] == [("b", 0), ("Beam Theory", 0), ("Beam Theory", 1)]
    assert "skill_name: b" in catalog.brief(cards).first()["brief"]
    loaded = catalog.load(cards, ["b", " ", "Beam Theory", "b"]).collect()
    assert [r["name"] for r in loaded] == ["b", "Beam Theory", "b"] and "/one/" in loaded[1]["path"]
    with pytest.raises(LookupError):
        catalog.load(cards, ["nope"])
    assert catalog.skills(spark, [str(tmp_path / "missing")]).count() == 0


def test_workflows_and_manifests(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("Workflow:\n  Goal: ' fall '\n  Stages:\n  - id: 1\n")
    (tmp_path / "b.yml").write_text("workflow: {goal: g}")
    (tmp_path / "c.yml").write_text("a: [")
    (tmp_path / "d.yml").write_text("Workflow: {}")
    assert sorted(r["goal"] for r in catalog.workflows(spark, str(tmp_path)).collect()) == ["fall", "g"]
    for name, body in (("x", "id: s1\ndomain: B\ngoal: do\nscope: [p, q]"), ("y", "skill_id: s2\ndomain: a\nmethod: [m]")):
        (tmp_path / "m" / name).mkdir(parents=True)
        (tmp_path / "m" / name / "skill.yaml").write_text(body)
    rows = catalog.manifests(spark, str(tmp_path / "m"))
    text_ = catalog.manifest_brief(rows).first()["brief"]
    assert text_.index("s2") < text_.index("s1") and "    - p\n    - q" in text_
    (tmp_path / "m" / "z").mkdir()
    (tmp_path / "m" / "z" / "skill.yaml").write_text("id: s1")
    with pytest.raises(ValueError, match="s1"):
        catalog.manifests(spark, str(tmp_path / "m"))


def test_files(spark, tmp_path):
    assert files.split_push("a\n\n b\nrest") == (["a", " b"], "rest")
    parsed = files.ndjson(spark.createDataFrame([('{"a":1}',), ("{oops",), ("  ",)], "value string"), "a int")
    report = files.ingest_report(parsed).first()
    assert (report["n_good"], report["n_bad"], report["bad_lines"]) == (1, 1, ["{oops"])
    assert files.load_settings(str(tmp_path / "none.yaml"), required=False) == {}
    with pytest.raises(FileNotFoundError):
        files.load_settings(str(tmp_path / "none.yaml"))
    (tmp_path / "q.txt").write_text("line 1\nline 2")
    assert files.query_files(spark, str(tmp_path / "q.txt")).first()["text"] == "line 1\nline 2"
    summaries = spark.createDataFrame([("t", "# S\n")], "task string, summary string")
    files.write_summaries(summaries, str(tmp_path / "md"))
    assert next((tmp_path / "md" / "task=t").glob("part*")).read_text() == "# S\n"


def test_external(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x.upper()

    assert external.with_retries(flaky, 4, 0)("a") == "A" and len(calls) == 3
    assert external.with_retries(lambda x: 1 / 0, 2, 0)("a") is None
    prompts = spark.createDataFrame([("p",), ("q",)], "prompt string")
    assert [r["reply"] for r in external.complete(prompts, "prompt", str.upper, attempts=1).orderBy("prompt").collect()] == ["P", "Q"]
    recorded = prompts.where("prompt = 'p'").select(external.prompt_key("prompt").alias("prompt_key"), F.lit("r").alias("reply"))
    assert [r["reply"] for r in external.replay(prompts, "prompt", recorded).orderBy("prompt").collect()] == ["r", None]


def test_tools(spark):
    registry = tools.Registry()
    registry.add(tools.Tool("add-up", "adds", {}, lambda a, b: a + b))
    assert registry.call("add_up", '{"a": 1, "b": 2}') == "3"
    assert "not implemented" in registry.call("no", "{}") and "Traceback" in registry.call("add-up", "{}")
    assert registry.frame(spark).first()["tool_key"] == "add_up"
    replies = iter([{"content": "", "tool_calls": [{"id": "1", "name": "add-up", "arguments": '{"a": 1, "b": 1}'}]}, {"content": "done"}])
    assert tools.tool_loop(lambda messages: next(replies), registry, "s", "u") == "done"
    assert tools.tool_loop(lambda messages: {"content": "more", "tool_calls": [{"id": "1", "name": "x"}]}, registry, "s", "u", turns=3) == "more"


def test_stream_resets_and_ends(spark, tmp_path):
    rows = [("a", 1, "x", False, False), ("a", 2, "y", True, False), ("a", 3, "late", False, False), ("a", 4, "r", False, True), ("a", 5, "again", False, False), ("b", 1, "only", False, False)]
    schema = "session string, seq int, value string, terminal boolean, reset boolean"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    out = sessions.open_sessions(spark.readStream.schema(schema).json(str(tmp_path / "in")), "session", "seq", "value", "terminal")
    got = sessions.run_available(out, "session_rows").orderBy("session", "seq").collect()
    assert [(r["session"], r["value"]) for r in got] == [("a", "x"), ("a", "y"), ("a", "again"), ("b", "only")]


def test_stream_items(spark):
    made = spark.range(1).select(sessions.start_item().alias("s"), sessions.end_item().alias("e"), sessions.code_result_item(F.lit("4")).alias("c")).first()
    assert made["s"]["stream_state"] == "start" and made["c"]["content"] == "4"
    assert spark.range(1).select(records.is_terminal(F.lit(made["e"]["stream_state"]), F.lit(made["e"]["sub_stream_type"]))).first()[0] is True


def test_best_match_of_any_ids(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "id int, text string")
    goals = spark.createDataFrame([("b.yaml", "alpha beta"), ("a.yaml", "beta alpha"), ("c.yaml", "nothing")], "path string, text string")
    assert [tuple(r)[:3] for r in matching.best_match(docs, goals, "id", "text", "path", "text").collect()] == [(1, "a.yaml", 2)]


def test_blank_lines_of_any_kind_are_no_records(spark):
    parsed = files.ndjson(spark.createDataFrame([("\t",), (" \r",), ('{"a": 1}',)], "value string"), "a int")
    assert [(r["record"]["a"], r["bad"]) for r in parsed.collect()] == [(1, False)]


def test_nearest_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "id int, v array<double>")
    whole = sorted(tuple(r) for r in matching.nearest(rows, rows, "id", "v", "id", "v").collect())
    monkeypatch.setattr(matching, "SMALL", 9)
    assert sorted(tuple(r) for r in matching.nearest(rows, rows, "id", "v", "id", "v").collect()) == whole
    assert matching.nearest(rows.limit(0), rows, "id", "v", "id", "v").count() == 0


def test_nearest_meets_chunks_as_matrices(spark):
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    rows = [(f"{i:x}", v) for i, v in enumerate(base + base[:40] * 9 + [[2.5 * x for x in v] for v in base[:10]])]
    rows += [("null", None), ("none", []), ("zero", [0.0] * 8), ("minus", [-0.0] * 8), ("hole", [None] + [1.0] * 7), ("short", [1.0, 2.0]), ("short too", [2.0, 1.0]), ("tiny", [1e-120] * 8), ("huge", [1e100] * 8)]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(5)

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a + b:
            return None
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        norm = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return dot(a, b) / norm if norm else None

    want = set()
    for q, a in rows:
        near = sorted((-round(s, 9), c) for c, b in rows if (s := cosine(a, b)) is not None)
        want |= {(q, -s, rank) for rank, (s, _) in enumerate(near[:6], 1)}
    found = matching.nearest(df, df, "id", "v", "id", "v", 6)
    assert "Loop" not in found._jdf.queryExecution().toString()  # pair by pair in the JVM it took half a minute for two million pairs
    got = found.collect()
    assert {(x["query"], round(x["similarity"], 9), x["rank"]) for x in got} == want
    vectors = dict(rows)
    copies = lambda q: sorted(c for c, v in rows if v == vectors[q])[:6]
    assert [x["chunk"] for x in sorted(got, key=lambda x: x["rank"]) if x["query"] == "14"] == copies("14")


def test_prior_search_formats_and_filters(spark):
    chunks = spark.createDataFrame([(1, "s", 1, "c", "2.1", "One here", [1.0, 0.0]), (2, "s", 2, "c", "2.10", "two", [1.0, 0.1]), (3, "t", 1, None, "21", "three", [0.9, 0.0])],
                                   "chunk_id int, source_id string, pos int, chapter string, section string, text string, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "q int, v array<double>")
    found = lambda **f: [r["answer"] for r in matching.prior_search(asked, chunks, "q", "v", **f).collect()]
    assert found(section_prefix="2.1") == ["[1] s 2.1\nOne here"] and found(section_prefix="2", chapter="c", keywords=["ONE", "x"], expand=True) == ["[1] s 2.1\nOne here\ntwo"]
    assert json.loads(found(as_json=True, top_k_=1, source_ids=["t"])[0]) == [{"source_id": "t", "section": "21", "text": "three"}] and found(chapter="none") == []


def test_calls_with_limits():
    slow = external.with_timeout(lambda x: time.sleep(1.0) or x, 0.05)
    with pytest.raises(TimeoutError):
        slow("a")
    assert external.with_timeout(str.upper, 5)("a") == "A"
    paced = external.with_rate(str.upper, 50)
    began = time.monotonic()
    assert [paced(x) for x in "abcd"] == list("ABCD") and time.monotonic() - began >= 0.055


def test_missing_model_is_an_error(spark):
    calls = spark.createDataFrame([("m",), ("n",)], "model string")
    with pytest.raises(LookupError, match="n"):
        external.call_models(calls, spark.createDataFrame([("m", 1)], "model string, window int"))


def test_tool_schemas():
    assert tools.role_tools("solver") == ["Python_code_interpreter", "load_skill_specs", "library_search", "library_parse"] and tools.role_tools("critic", library=False) == ["prior_search"]
    assert tools.tool_schema("load_skill_specs") == {"type": "object", "properties": {"skill_names": {"type": "array", "items": {"type": "string"}}}, "required": ["skill_names"]}


@pytest.mark.parametrize("scope,want", [('["a", "b"]', "    - a\n    - b"), ('"one"', "    - one"), ("7", "    - 7"), ("null", ""), ('""', ""), (None, ""), ("[]", "")])
def test_scope_lines(spark, scope, want):
    assert one(spark, text.scope_lines("t"), t=scope) == want


def test_repaired_subtasks_are_in_order(spark):
    rows = spark.createDataFrame([("t", 0, 5, "e"), ("t", 1, None, " "), ("t", 2, 2, "b"), ("t", 3, 6, "c")], "task string, pos int, id int, description string")
    got = sorted((r["place"], r["pos"], r["id"], r["description"]) for r in contracts.repair_subtasks(rows).collect())
    assert got == [(0, 2, 2, "b"), (1, 0, 5, "e"), (2, 1, 6, "Subtask 6"), (3, 3, 7, "c")]


def test_live_loop_falls_back(spark, tmp_path):
    tasks = spark.createDataFrame([("t", 1, "do it")], "task string, subtask int, description string")
    seen = []

    def store(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen.extend((r["description"], r["result"]) for r in out.collect())
        return out

    describe = lambda df: df.withColumn("generated", F.lit("  "))
    solve = lambda df: df.withColumn("result", F.lit(None).cast("string")).withColumn("error", F.lit("no tool"))
    critique = lambda df: df.withColumn("decision", F.lit("complete")).withColumn("reward", F.lit(0.0)).withColumn("summary", F.lit(""))
    refine.run_live(tasks, solve, critique, 1, store, describe)
    assert seen == [("do it", '{"error":"no tool"}')]


def test_shared_folder_is_left_empty(tmp_path):
    code = (
        "from quillspark.session import build_session\n"
        f"s = build_session('local[2]', shuffle_partitions=2, driver_memory='1g', spark_checkpoint_dir='{tmp_path}/shared')\n"
        "from quillspark.plans import record_queries as r\n"
        "assert r.summary_files(s, '/root/testdata/sf0.001').count() and r.stream_poll(s, '/root/testdata/sf0.001').count()\n"
        "s.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=240, capture_output=True)
    assert [p for p in (tmp_path / "shared").rglob("*") if p.is_file()] == []


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session)
