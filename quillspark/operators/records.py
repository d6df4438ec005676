"""Ordered deduplication, lookups and stream cuts over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; order must be given descending."""
    return first_wins(df, by, order)


def duplicates(df: DataFrame, by: str, path: str, order: list[Column]) -> DataFrame:
    """key, first_path and dup_path of every later row of a key."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first(path).over(w))
    return rows.where("_n > 1").select(F.col(by).alias("key"), F.col("_first").alias("first_path"), F.col(path).alias("dup_path"))


def lookup(requests: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Requests with what the catalog has on them; the order column and repeated requests stay."""
    return requests.join(catalog, key)


def missing(requests: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Requests, repeated ones too, that the catalog doesn't have."""
    return requests.join(catalog.select(key).distinct(), key, "left_anti")


def require_all(requests: DataFrame, catalog: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """lookup(), or an error that names the first missing keys."""
    gone = [str(r[key]) for r in missing(requests, catalog, key).limit(shown).collect()]
    if gone:
        raise LookupError(f"not found: {', '.join(gone)}")
    return lookup(requests, catalog, key)


def default_result(calls: DataFrame, tools: DataFrame, key: str, result: str) -> DataFrame:
    """Tool calls with their result; a tool that isn't there answers that it isn't implemented."""
    return calls.join(tools.withColumn("_known", F.lit(True)), key, "left").withColumn(
        result, F.when(F.col("_known"), F.col(result)).otherwise(F.concat(F.lit("tool "), F.col(key), F.lit(" is not implemented")))).drop("_known")


def allowed_tools(tools: DataFrame, server: str, name: str, allow: dict[str, tuple[str, ...]]) -> DataFrame:
    """Tools without those that a server's allow-list doesn't name; servers without a list offer all."""
    test = F.lit(True)
    for s, names in allow.items():
        test = test & ((F.col(server) != s) | F.col(name).isin(*names))
    return tools.where(F.coalesce(test, F.lit(True)))


def all_tools(*lists: DataFrame) -> DataFrame:
    """Tool lists one after the other, each with its place as list_pos; a tool that is in several stays in all."""
    out = None
    for i, tools in enumerate(lists):
        rows = tools.withColumn("list_pos", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_result(results: Column | str) -> Column:
    """The first of a call's results; null for none."""
    return F.try_element_at(results if isinstance(results, Column) else F.col(results), F.lit(1))


def merged(*records: Column) -> Column:
    """Maps merged key by key; a later one's value wins, null or not."""
    def over(left: Column, right: Column) -> Column:
        return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)

    return reduce(over, [F.coalesce(r, F.create_map().cast("map<string,string>")) for r in records])


def elapsed_seconds(start: Column, stop: Column) -> Column:
    """Seconds between two timestamps, with their fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(stop) - micros(start)) / F.lit(1e6)


def is_terminal(state: Column, sub_stream: Column) -> Column:
    """The end of a session itself; an end inside a sub-stream isn't one."""
    return (state == "end") & (F.coalesce(sub_stream, F.lit("")) == "")


def take_until(df: DataFrame, by: list[str], order: list[Column], terminal: Column) -> DataFrame:
    """Rows of each group up to its first terminal row, that one included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_ended", F.coalesce(F.max(F.when(terminal, 1).otherwise(0)).over(w), F.lit(0))).where("_ended = 0").drop("_ended")


def last_filled(df: DataFrame, by: list[str], order: str, text: str, role: str, wanted: str = "assistant") -> DataFrame:
    """The latest filled text of the wanted role in each group."""
    fit = df.where((F.col(role) == wanted) & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    return fit.groupBy(*by).agg(F.max_by(text, order).alias(text), F.max(order).alias(order))


def route_page(url: Column, content_type: Column | None = None) -> Column:
    """`pdf` or `html`: a .pdf in the address as it is written, an arXiv paper, or a PDF content type."""
    pdf = url.contains(".pdf") | url.rlike(r"arxiv\.org/(abs|pdf)/")
    if content_type is not None:
        pdf = pdf | F.lower(F.coalesce(content_type, F.lit(""))).contains("pdf")
    return F.when(F.coalesce(pdf, F.lit(False)), F.lit("pdf")).otherwise(F.lit("html"))


def is_pdf(url: Column, body: Column) -> Column:
    """An address that ends with .pdf in any case, or a body that begins like one."""
    return F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False)) | F.coalesce(F.ltrim(body).startswith("%PDF"), F.lit(False))


def content_text(kind: Column, text: Column, image: Column, resource: Column) -> Column:
    """The part of a tool's answer that its kind names; other kinds give null."""
    return F.when(kind == "text", text).when(kind == "image", image).when(kind == "resource", resource)


def with_safe_tool_name(df: DataFrame, name: str) -> DataFrame:
    """tool_key: the name with - as _; both stay."""
    return df.withColumn("tool_key", F.replace(F.col(name), F.lit("-"), F.lit("_")))
