"""Trajectories as path graphs, their layout and the viewer's payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.jsonx import to_reward
from quillspark.functions.text import coalesce_filled, shorten_middle


def chain(nodes: DataFrame, by: list[str], order: str, node: str) -> DataFrame:
    """nodes with depth (from 0), parent_id and children (at most one)."""
    w = Window.partitionBy(*by).orderBy(order)
    return (
        nodes.withColumn("depth", F.row_number().over(w) - 1).withColumn("parent_id", F.lag(node).over(w))
        .withColumn("children", F.array_compact(F.array(F.lead(node).over(w))))
    )


def chain_layout(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    """nodes with viz_x and viz_y: one column from 0.08 to 0.92, a single node at 0.5."""
    w = Window.partitionBy(*by).orderBy(order)
    last = F.count(F.lit(1)).over(Window.partitionBy(*by)) - 1
    y = F.when(last == 0, F.lit(0.5)).otherwise(F.lit(0.08) + F.lit(0.84) * ((F.row_number().over(w) - 1) / last))
    return nodes.withColumn("viz_x", F.lit(0.5)).withColumn("viz_y", y)


def sibling_layout(nodes: DataFrame, by: list[str], depth: str, order: str) -> DataFrame:
    """Places for nodes that have none: spread over each depth."""
    w = Window.partitionBy(*by, depth)
    return nodes.withColumn("viz_x", F.row_number().over(w.orderBy(order)) / (F.count(F.lit(1)).over(w) + 1)).withColumn("viz_y", F.lit(0.12) + F.lit(0.16) * F.col(depth))


def max_depth(nodes: DataFrame, by: list[str], depth: str = "depth") -> DataFrame:
    """The greatest depth of each group's nodes, 0 where none has one."""
    return nodes.groupBy(*by).agg(F.coalesce(F.max(depth), F.lit(0)).alias("max_depth"))


def chain_edges(nodes: DataFrame, by: list[str], node: str) -> DataFrame:
    return nodes.select(*by, F.col(node).alias("src"), F.explode("children").alias("dst"))


def known_edges(edges: DataFrame, nodes: DataFrame, by: list[str], node: str) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    keys = nodes.select(*by, node)
    return edges.join(keys.withColumnRenamed(node, "src"), [*by, "src"], "left_semi").join(keys.withColumnRenamed(node, "dst"), [*by, "dst"], "left_semi")


def placed_edges(edges: DataFrame, nodes: DataFrame, by: list[str], node: str) -> DataFrame:
    """Edges with the places of both ends; edges with an unknown end drop out."""
    at = lambda end: nodes.select(*by, F.col(node).alias(end), F.col("viz_x").alias(f"{end}_x"), F.col("viz_y").alias(f"{end}_y"))
    return edges.join(at("src"), [*by, "src"]).join(at("dst"), [*by, "dst"])


def viewer_nodes(nodes: DataFrame) -> DataFrame:
    """The viewer's fields of attempts (task, node_id, subtask_id, description, memory, output, reward, node_type, ...), long texts cut in the middle."""
    text = lambda c, n: shorten_middle(F.coalesce(c, F.lit("")), n).alias(c)
    return nodes.select(
        "task", "node_id", "parent_id", "children", "depth", "viz_x", "viz_y", F.coalesce("node_type", F.lit("draft")).alias("node_type"),
        F.struct(F.col("subtask_id").alias("id"), "description").alias("subtask"), text("description", 4000), to_reward(F.col("reward").cast("string")).alias("reward"),
        F.lit(1).alias("visits"), F.lit("completed").alias("status"), F.lit("supervisor").alias("created_by"), text("memory", 4000), text("theoretician_output", 48000),
        coalesce_filled("evaluation", "critic_feedback").alias("critic_feedback"))


def payload(nodes: DataFrame, edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """task and payload (JSON text) from viewer nodes, edges(task, src, dst) and tasks(task, task_description, summary); a task's own nodes only."""
    columns = [c for c in nodes.columns if c != "task"]
    grouped = nodes.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("depth", *[c for c in columns if c != "depth"]))).alias("nodes"))
    pairs = edges.groupBy("task").agg(F.array_sort(F.collect_list(F.array("src", "dst"))).alias("edges"))
    empty = F.array().cast(f"array<array<{edges.schema['src'].dataType.simpleString()}>>")
    return tasks.join(grouped, "task", "left").join(pairs, "task", "left").select("task", F.to_json(F.struct(
        F.coalesce("task_description", F.lit("")).alias("task_description"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce(F.try_element_at(F.col("nodes"), F.lit(1))["node_id"], F.lit(0)).alias("root_id"), "nodes", F.coalesce("edges", empty).alias("edges"))).alias("payload"))
