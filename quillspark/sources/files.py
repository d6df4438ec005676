"""File sources and sinks: whole texts, NDJSON, contracts, Markdown and HTML reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import strip

try:
    import yaml
except ImportError:
    yaml = None


def whole_files(spark: SparkSession, root: str, pattern: str, recursive: bool = False) -> DataFrame:
    """path and text of the files below root whose name fits the pattern; one level unless recursive."""
    rows = spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def query_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of query files, each read whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def load_settings(path: str, required: bool = True, needed: tuple[str, ...] = ()) -> dict:
    """A YAML mapping; a missing file is an error or {}. `needed` keys must be filled."""
    if not Path(path).exists() and not required:
        return {}
    if yaml is None:
        raise RuntimeError("settings need the yaml module")
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    empty = [k for k in needed if not found.get(k)]
    if empty:
        raise ValueError(f"settings without {', '.join(empty)}")
    return found


def settings_frame(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """key and value (JSON text) of a YAML mapping at any path that Spark reads; `needed` keys must be filled."""
    if yaml is None:
        raise RuntimeError("settings need the yaml module")
    rows = query_files(spark, path).limit(1).collect()
    found = (yaml.safe_load(rows[0]["text"]) if rows else None) or {}
    empty = [k for k in needed if not found.get(k)]
    if empty:
        raise ValueError(f"settings without {', '.join(empty)}")
    return spark.createDataFrame([(str(k), json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=str)) for k, v in found.items()], "key string, value string")


def stored_contracts(passed: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """Contracts as they are stored below path, JSON lines of key and text, where they are; else as they were passed."""
    kind = passed.schema[key].dataType.simpleString()
    stored = passed.sparkSession.read.schema(f"`{key}` {kind}, `{text}` string").json(path).select(F.col(key).alias("_key"), F.col(text).alias("_stored"))
    return passed.join(stored, passed[key] == F.col("_key"), "left").withColumn(text, F.coalesce("_stored", text)).drop("_key", "_stored")


def ndjson(lines: DataFrame, schema: str | T.StructType, line: str = "value") -> DataFrame:
    """Each line that isn't blank, parsed: line, record, and bad where it isn't JSON of the schema. Works on streams too."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    with_bad = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col(line), with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(strip(line) != "").withColumn("_r", parsed)
    return rows.select(F.col(line).alias("line"), F.struct(*[F.col(f"_r.{f.name}") for f in kind.fields]).alias("record"), F.col("_r._bad").isNotNull().alias("bad"))


def ingest_report(parsed: DataFrame, shown: int = 100) -> DataFrame:
    """One row: n_good, n_bad and the first bad lines in order of their text."""
    counts = parsed.agg(F.count_if(~F.col("bad")).alias("n_good"), F.count_if("bad").alias("n_bad"))
    bad = parsed.where("bad").select("line").orderBy("line").limit(shown).agg(F.array_sort(F.collect_list("line")).alias("bad_lines"))
    return counts.join(F.broadcast(bad), F.lit(True))  # a row on either side


def split_push(body: str) -> tuple[list[str], str]:
    """The complete lines of a pushed body, and the rest behind the last newline, which is not ingested."""
    lines, _, rest = body.rpartition("\n")
    return [x for x in lines.split("\n") if x.strip()], rest


def write_contracts(contracts: DataFrame, path: str) -> None:
    contracts.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_node_folders(nodes: DataFrame, path: str, node: str = "node_id") -> None:
    """The rows of each node as JSON lines in a folder of its own below path."""
    nodes.repartition(node).write.mode("overwrite").option("ignoreNullFields", False).partitionBy(node).json(path)


def append_items(items: DataFrame, path: str) -> None:
    """items(session_id, item) appended as JSON lines to the folder that a stream reads: a session's queue."""
    items.select(F.to_json(F.struct("session_id", "item"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def with_final_newline(c: str):
    return F.when(F.col(c).endswith("\n"), F.col(c)).otherwise(F.concat(F.col(c), F.lit("\n")))


def fallback_summary(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """task and summary: the plain Markdown of attempts(task, node_id, subtask_id, reward, description) under their task's description."""
    desc = F.trim(F.coalesce("description", F.lit("")))
    line = F.concat_ws("", F.lit(" node="), F.col("node_id").cast("string"), F.lit(" subtask="), F.col("subtask_id").cast("string"), F.lit(" reward="), F.col("reward").cast("string"),
                       F.when(desc != "", F.concat(F.lit("\n   - "), desc)))
    rows = attempts.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform(F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)), lambda x, i: F.concat((i + 1).cast("string"), F.lit("."), x["line"])), "\n")
    return tasks.join(rows, "task", "left").select("task", F.concat(F.rtrim(F.concat(F.lit("# Summary\n\n## Task\n"), F.coalesce("task_description", F.lit("")), F.lit("\n\n## Trajectory\n"), body)), F.lit("\n")).alias("summary"))


def write_summaries(summaries: DataFrame, path: str) -> None:
    """One Markdown file below a folder for each task."""
    summaries.select("task", F.regexp_replace("summary", r"\n$", "").alias("value")).repartition("task").write.mode("overwrite").partitionBy("task").text(path)


REPORT = """<!doctype html>
<html><head><meta charset="utf-8"><title>Trajectory</title>
<style>body{font:14px sans-serif;margin:0;display:flex}svg{width:40vw;height:100vh}pre{white-space:pre-wrap}main{padding:1em;flex:1;overflow:auto;height:96vh}circle{cursor:pointer}</style></head>
<body><svg viewBox="0 0 1 1"></svg><main></main><script>
const data = /*PAYLOAD*/null;
const at = new Map(data.nodes.map(n => [n.node_id, n]));
const svg = document.querySelector("svg"), main = document.querySelector("main");
const add = (name, attrs) => { const e = document.createElementNS("http://www.w3.org/2000/svg", name); for (const k in attrs) e.setAttribute(k, attrs[k]); svg.append(e); return e; };
for (const [a, b] of data.edges) if (at.has(a) && at.has(b)) add("line", {x1: at.get(a).viz_x, y1: at.get(a).viz_y, x2: at.get(b).viz_x, y2: at.get(b).viz_y, stroke: "#888", "stroke-width": .003});
const show = lines => { main.textContent = ""; for (const [h, t] of lines) { const e = document.createElement("h3"), p = document.createElement("pre"); e.textContent = h; p.textContent = typeof t === "string" ? t : JSON.stringify(t, null, 2); main.append(e, p); } };
for (const n of data.nodes) add("circle", {cx: n.viz_x, cy: n.viz_y, r: .02, fill: n.node_type === "draft" ? "#48c" : "#c84"}).onclick = () => show(Object.entries(n));
show([["Task", data.task_description], ["Summary", data.summary]]);
</script></body></html>
"""


def report(payload_json: str) -> str:
    """The viewer's page around one payload; no text in it can end the script."""
    return REPORT.replace("/*PAYLOAD*/null", payload_json.replace("</", "<\\/"))


def write_report(payloads: DataFrame, task: str, path: str) -> Path:
    """The page of one task, which must be there."""
    row = payloads.where(F.col("task") == task).first()
    if row is None:
        raise LookupError(f"no payload for {task}")
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(report(row["payload"]), encoding="utf-8")
    return out
