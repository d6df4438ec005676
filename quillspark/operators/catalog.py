"""Catalogs of skill cards, workflow cards and manifests, from drop-in files."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import coalesce_filled, collapse_space, first_paragraph, front_matter_value, goal_line, parent_folder, scope_bullets, without_front_matter
from quillspark.operators.records import duplicates, first_wins, require_all
from quillspark.sources.files import whole_files

try:
    import yaml
except ImportError:  # cards in YAML can't be read then
    yaml = None


def yaml_to_json(c: Column) -> Column:
    """A YAML document as JSON text; null where it is no valid YAML."""
    if yaml is None:
        raise RuntimeError("YAML cards need the yaml module")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return json.dumps(yaml.safe_load(text or ""), default=str, ensure_ascii=False)
            except yaml.YAMLError:
                return None

        return texts.map(one)

    return run(c)


def existing(roots: list[str]) -> list[str]:
    """Roots in order, each once, without local ones that don't exist."""
    return [r for r in dict.fromkeys(roots) if ":/" in r or Path(r).is_dir()]


def skills(spark: SparkSession, roots: list[str]) -> DataFrame:
    """name, description, summary, path, root, body of every SKILL.md below the roots; a skill without a name has its folder's."""
    frames = [whole_files(spark, root, "SKILL.md", recursive=True).withColumn("root", F.lit(root)).withColumn("root_pos", F.lit(i)) for i, root in enumerate(existing(roots))]
    if not frames:
        return spark.createDataFrame([], "name string, description string, summary string, path string, root string, body string, root_pos int")
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other)
    return rows.select(
        F.coalesce(front_matter_value("text", "name"), parent_folder("path")).alias("name"), F.coalesce(front_matter_value("text", "description"), F.lit("")).alias("description"),
        first_paragraph(without_front_matter("text")).alias("summary"), "path", "root", F.col("text").alias("body"), "root_pos")


def in_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.lower("name"), "root_pos", "path")


def brief(catalog: DataFrame) -> DataFrame:
    """One row, brief: name, description (or summary) and path of each skill, bodies unread."""
    line = F.concat(F.lit("- skill_name: "), F.col("name"), F.coalesce(F.concat(F.lit("\n  description: "), coalesce_filled("description", "summary")), F.lit("")), F.lit("\n  path: "), F.col("path"))
    entries = F.array_sort(F.collect_list(F.struct(F.lower("name").alias("a"), F.col("root_pos").alias("b"), F.col("path").alias("c"), line.alias("line"))))
    text = F.array_join(F.transform(entries, lambda e: e["line"]), "\n")
    return catalog.agg(F.concat(F.lit("[SKILL BRIEF]\n"), F.when(F.count(F.lit(1)) == 0, F.lit("No skills.")).otherwise(text)).alias("brief"))


def load(catalog: DataFrame, names: list[str]) -> DataFrame:
    """pos, name, path, body of the named skills: request order and repeats stay, the first of a name counts, a miss is an error."""
    asked = [n.strip() for n in names if n.strip()]
    requests = catalog.sparkSession.createDataFrame(list(enumerate(asked)), "pos int, name string")
    unique = first_wins(catalog, ["name"], [F.lower("name"), F.col("root_pos"), F.col("path")])
    return require_all(requests, unique.select("name", "path", "body"), "name").orderBy("pos")


def workflows(spark: SparkSession, root: str) -> DataFrame:
    """path, goal, raw, stages (JSON text) of each readable *.yml or *.yaml directly below root that has a goal."""
    rows = whole_files(spark, root, "*.y*ml").withColumn("doc", F.try_parse_json(yaml_to_json(F.col("text"))))
    get = lambda *paths: coalesce_filled(*[F.try_variant_get("doc", p, "string") for p in paths])
    goal = F.trim(get("$.Workflow.Goal", "$.Workflow.goal", "$.workflow.Goal", "$.workflow.goal"))
    return rows.select("path", goal.alias("goal"), F.col("text").alias("raw"), get("$.Workflow.Stages", "$.workflow.Stages", "$.workflow.stages").alias("stages")).where(F.coalesce("goal", F.lit("")) != "")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """skill_id, domain, goal, scope, inputs, outputs, method, quality_gate, path of each skill.yaml below root, missing ones empty.

    A file that is no mapping, a missing id and a repeated id are errors.
    """
    rows = whole_files(spark, root, "skill.yaml", recursive=True).withColumn("json", yaml_to_json(F.col("text")))
    mapping = F.ltrim("json").startswith("{")
    doc = F.try_parse_json(F.when(mapping, F.col("json")).otherwise(F.raise_error(F.concat(F.lit("no mapping: "), F.col("path")))))
    text = lambda *n: F.coalesce(coalesce_filled(*[F.try_variant_get("doc", f"$.{x}", "string") for x in n]), F.lit(""))
    items = lambda n: F.coalesce(F.try_variant_get("doc", f"$.{n}", "array<string>"), F.array().cast("array<string>")).alias(n)
    fields = lambda n: F.coalesce(F.try_variant_get("doc", f"$.{n}", "map<string,string>"), F.create_map().cast("map<string,string>")).alias(n)
    out = rows.withColumn("doc", doc).select(text("skill_id", "id").alias("skill_id"), text("domain").alias("domain"), text("goal").alias("goal"), items("scope"), fields("inputs"), fields("outputs"), items("method"), items("quality_gate"), "path")
    unnamed = [r["path"] for r in out.where("skill_id = ''").limit(10).collect()]
    if unnamed:
        raise ValueError(f"manifests without an id: {', '.join(unnamed)}")
    twice = duplicates(out, "skill_id", "path", [F.col("path")]).limit(10).collect()
    if twice:
        raise ValueError("; ".join(f"{r['key']}: {r['first_path']}, {r['dup_path']}" for r in twice))
    return out


def manifest_brief(rows: DataFrame) -> DataFrame:
    """One row, brief: id, domain, goal and scope of each manifest, by domain and id without case."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(f"\n  {label}"), c)).otherwise(F.lit(""))
    line = F.concat(F.lit("- skill_id: "), F.col("skill_id"), part("domain: ", F.trim("domain")), part("goal: ", goal_line(collapse_space("goal"))), part("scope:\n", scope_bullets(F.col("scope"))))
    entries = F.array_sort(F.collect_list(F.struct(F.lower("domain").alias("a"), F.lower("skill_id").alias("b"), line.alias("line"))))
    return rows.agg(F.concat(F.lit("[SKILL MANIFESTS]\n"), F.array_join(F.transform(entries, lambda e: e["line"]), "\n\n")).alias("brief"))


def write_brief(brief_rows: DataFrame, path: str) -> None:
    """The one row's prompt as a text file below a folder."""
    brief_rows.select("brief").coalesce(1).write.mode("overwrite").text(path)
