"""Contracts: what a task asks for, as normalized rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip

# The fields of a contract, and the other names a field may have.
CONTRACT_FIELDS = ("topic", "domain", "subdomain", "task_type", "task_background", "task_description", "related_knowledge", "constraints",
                   "input", "expected_output", "subtasks", "instruction_filename")
SUBTASK_FIELDS = ("sub-tasks", "sub_tasks", "subtasks")
DESCRIPTION_FIELDS = ("description", "objective", "task", "name")
DEFAULT_TYPE = "reasoning"


def _at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def _filled(doc: Column, names: tuple[str, ...]) -> Column:
    """The first field that is not null, '', 0, false, [] or {}, as text."""
    read = lambda n: _at(doc, f"$['{n}']")
    return F.coalesce(*[F.when(~F.coalesce(read(n), F.lit("")).isin("", "0", "0.0", "false", "[]", "{}"), read(n)) for n in names])


def known_fields(text: Column | str, fields: tuple[str, ...] = CONTRACT_FIELDS) -> Column:
    """A contract's JSON object without unknown top-level fields, as JSON text; other values pass as they are."""
    text = text if isinstance(text, Column) else F.col(text)
    doc = F.try_parse_json(text)
    entries = F.from_json(text, "map<string,string>")
    kept = F.map_filter(entries, lambda k, v: k.isin(*fields))
    pieces = [F.when(F.array_contains(F.map_keys(kept), f), F.concat(F.lit(f'"{f}":'), F.coalesce(F.to_json(F.try_variant_get(doc, f"$['{f}']", "variant")), F.lit("null")))) for f in fields]
    return F.when(F.schema_of_variant(doc).startswith("OBJECT"), F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))).otherwise(text)


def subtask_items(contracts: DataFrame, task: str, text: str) -> DataFrame:
    """task, pos, item (JSON text): the subtasks of a contract that may be a list, an object (its values), one text, or missing.

    Without any, the task itself is the one subtask.
    """
    doc = F.try_parse_json(F.col(text))
    given = _filled(doc, SUBTASK_FIELDS)
    as_list = F.coalesce(F.from_json(given, "array<string>"), F.array().cast("array<string>"))
    as_map = F.coalesce(F.map_values(F.from_json(given, "map<string,string>")), F.array().cast("array<string>"))
    items = F.when(F.ltrim(given).startswith("["), as_list).when(F.ltrim(given).startswith("{"), as_map).when(given.isNotNull(), F.array(given)).otherwise(F.array().cast("array<string>"))
    whole = F.to_json(F.struct(F.lit(1).alias("id"), F.coalesce(_at(doc, "$.task_description"), F.lit("")).alias("description"), F.lit(DEFAULT_TYPE).alias("subtask_type")))
    some = F.when(F.size(items) > 0, items).otherwise(F.array(whole))
    return contracts.select(F.col(task).alias("task"), doc.alias("_doc"), F.posexplode(some).alias("pos", "item"))


def normalize_subtasks(contracts: DataFrame, task: str, text: str) -> DataFrame:
    """task, pos, id (null if unusable), description, subtask_type, input, expected_output of each subtask, ids not yet repaired.

    input and expected_output come from the contract only where the subtask has no such field; a null that is given stays.
    """
    rows = subtask_items(contracts, task, text).withColumn("_v", F.when(F.ltrim("item").startswith("{"), F.try_parse_json("item")))
    v, doc = F.col("_v"), F.col("_doc")
    keys = F.map_keys(F.from_json("item", "map<string,string>"))
    inherit = lambda f: F.when(v.isNotNull() & F.array_contains(keys, f), _at(v, f"$.{f}")).otherwise(F.coalesce(_at(doc, f"$.{f}"), F.lit("")))
    kind = F.nullif(strip(F.coalesce(_at(v, "$.subtask_type"), F.lit(""))), F.lit(""))
    return rows.select(
        "task", "pos", F.try_variant_get(v, "$.id", "string").try_cast("int").alias("id"),
        strip(F.when(v.isNull(), F.col("item")).otherwise(F.coalesce(_filled(v, DESCRIPTION_FIELDS), F.lit("")))).alias("description"),
        F.coalesce(kind, F.lit(DEFAULT_TYPE)).alias("subtask_type"), inherit("input").alias("input"), inherit("expected_output").alias("expected_output"))


def repaired_ids(ids: Column) -> Column:
    """Ids in order, with each null or used one replaced by one more than the largest so far (1 at first).

    A later id that equals a replacement is itself replaced. A fold, as each step needs all before.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(1).alias("next"))

    def step(acc: Column, x: Column) -> Column:
        chosen = F.when(x.isNull() | F.array_contains(acc["used"], x), acc["next"]).otherwise(x)
        return F.struct(F.concat(acc["used"], F.array(chosen)).alias("used"), F.greatest(acc["next"], chosen + 1).alias("next"))

    return F.aggregate(ids, start, step, lambda acc: acc["used"])


def repair_subtasks(rows: DataFrame, task: str = "task", pos: str = "pos") -> DataFrame:
    """Rows (task, pos, id, description) with unique ids and no blank description; place (from 0) is their order by id within each task."""
    lists = rows.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(pos, "id", "description"))).alias("items"))  # a contract's own subtasks
    ids = repaired_ids(F.transform("items", lambda x: x["id"]))
    by_id = F.array_sort(F.zip_with("items", "ids", lambda x, i: F.struct(i.alias("id"), x[pos].alias(pos), x["description"].alias("description"))))
    out = lists.withColumn("ids", ids).select(task, F.posexplode(by_id).alias("place", "x")).select(task, "place", F.col(f"x.{pos}").alias(pos), "x.id", "x.description")
    blank = strip(F.coalesce("description", F.lit(""))) == ""
    return out.withColumn("description", F.when(blank, F.concat(F.lit("Subtask "), F.col("id").cast("string"))).otherwise(F.col("description")))
