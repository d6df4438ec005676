"""The draft, critique and revise loop: replayed from an attempt log, or run live one round at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.jsonx import next_node_type, to_reward
from quillspark.functions.text import strip


def replay(log: DataFrame, max_rounds: int, task: str = "task", subtask: str = "subtask", attempt: str = "attempt", decision: str = "decision") -> DataFrame:
    """The attempts that the loop would have run, with round (from 1) and node_type.

    A subtask stops at its first complete; the next begins only when all earlier ones are complete; one
    budget of rounds holds for the whole task. All windows are by task, so tasks run in parallel.
    """
    inside = Window.partitionBy(task, subtask).orderBy(attempt)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    done = F.when(F.col(decision) == "complete", 1).otherwise(0)
    earlier = Window.partitionBy(task).orderBy(subtask).rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(task, subtask)
    rows = (
        log.withColumn("_stopped", F.coalesce(F.max(done).over(before), F.lit(0))).withColumn("_complete", F.max(done).over(whole))
        .where("_stopped = 0").withColumn("_open", F.coalesce(F.min("_complete").over(earlier), F.lit(1))).where("_open = 1")
        .withColumn("round", F.row_number().over(Window.partitionBy(task).orderBy(subtask, attempt))).where(F.col("round") <= max_rounds)
    )
    previous = F.lag(decision).over(inside)
    return rows.withColumn("node_type", F.when(previous.isNull(), F.lit("draft")).otherwise(next_node_type(previous))).drop("_stopped", "_complete", "_open")


def best_attempts(attempts: DataFrame, by: list[str], reward: Column, tie: list[Column], decision: str = "decision") -> DataFrame:
    """The complete attempt of the highest reward in each group; the earliest among equals."""
    w = Window.partitionBy(*by).orderBy(reward.desc(), *tie)
    return attempts.where(F.col(decision) == "complete").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def completed(attempts: DataFrame, by: str = "task", subtask: str = "subtask_id", order: str = "node_id") -> DataFrame:
    """by, place (from 0, by subtask), subtask, description, result, reward and log_path of each subtask's best complete attempt."""
    best = best_attempts(attempts, [by, subtask], to_reward(F.col("reward").cast("string")), [F.col(order)])
    place = F.row_number().over(Window.partitionBy(by).orderBy(subtask)) - 1
    return best.select(by, place.alias("place"), subtask, "description", "result", "reward", F.coalesce("log_path", F.lit("")).alias("log_path"))


def node_records(outputs: DataFrame) -> DataFrame:
    """outputs(task, node_id, subtask_id, node_type, description, result, depth, log_path) as a trajectory's records: missing depths count on, reward, memory and evaluation are still empty."""
    nth = F.row_number().over(Window.partitionBy("task").orderBy("node_id"))
    result = F.coalesce("result", F.lit(""))
    return outputs.select("task", "node_id", F.coalesce(F.col("depth"), nth).cast("int").alias("depth"), "subtask_id", "node_type", "description", result.alias("result"), result.alias("theoretician_output"),
                          F.coalesce("log_path", F.lit("")).alias("log_path"), F.lit(0.0).alias("reward"), F.lit("").alias("memory"), F.lit("{}").alias("evaluation"))


def critic_input(output: Column | str) -> Column:
    """struct(result, context): what a critic sees of a solver's output, an object as JSON text; results under either name, the rest as JSON."""
    doc = F.try_parse_json(output if isinstance(output, Column) else F.col(output))
    text = lambda name: F.nullif(F.try_variant_get(doc, f"$.{name}", "string"), F.lit(""))
    files = F.coalesce(F.try_variant_get(doc, "$.files", "array<string>"), F.array().cast("array<string>"))
    context = F.to_json(F.struct(F.coalesce(text("analysis"), F.lit("")).alias("analysis"), F.coalesce(text("code"), F.lit("")).alias("code"), files.alias("files")))
    return F.struct(F.coalesce(text("core_results"), text("core_result"), F.lit("")).alias("result"), context.alias("context"))


def solved_or_error(result: Column, error: Column) -> Column:
    """A solver's result, or where it failed {"error": reason}."""
    return F.coalesce(result, F.to_json(F.struct(F.coalesce(error, F.lit("")).alias("error"))))


def described(generated: Column, original: Column) -> Column:
    """The supervisor's description, or where there is none the subtask's own."""
    return F.coalesce(F.nullif(strip(generated), F.lit("")), original)


def path_memory(rows: DataFrame, by: list[str], order: str, text: str, out: str = "memory", with_current: bool = True) -> DataFrame:
    """The stripped, filled texts up to each row, a line each; without the current row's own if asked so."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if with_current else -1)
    return rows.withColumn(out, F.array_join(F.collect_list(F.nullif(strip(text), F.lit(""))).over(w), "\n"))


def run_live(tasks: DataFrame, solve: Callable[[DataFrame], DataFrame], critique: Callable[[DataFrame], DataFrame], max_rounds: int,
             store: Callable[[DataFrame, str], DataFrame], describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All tasks' loops at once, a round at a time: tasks(task, subtask, description) to attempts.

    Each round takes the open subtask of each task that has budget. describe, if given, adds generated, which stands for the
    description unless it is null or blank. solve adds result, null where it failed, which becomes {"error": ""}, or the reason in a
    column `error`; critique adds decision, reward and summary, and its failure ends the run. store writes a frame and
    reads it back, and so ends its lineage.
    """
    spark = tasks.sparkSession
    log = None
    for number in range(1, max_rounds + 1):
        if log is None:
            state = tasks.withColumn("attempt", F.lit(1)).withColumn("node_type", F.lit("draft")).withColumn("memory", F.lit(""))
            done = spark.createDataFrame([], "task string, subtask int")
        else:
            last = log.groupBy("task", "subtask").agg(F.max_by("decision", "attempt").alias("last"), F.max("attempt").alias("n"))
            notes = log.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("round", "summary"))).alias("notes"))  # as long as the budget
            memory = F.array_join(F.filter(F.transform("notes", lambda x: strip(x["summary"])), lambda x: x != ""), "\n")
            done = last.where("last = 'complete'").select("task", "subtask")
            state = (
                tasks.join(last, ["task", "subtask"], "left").join(notes, "task", "left")
                .withColumn("attempt", F.coalesce("n", F.lit(0)) + 1).withColumn("memory", F.coalesce(memory, F.lit("")))
                .withColumn("node_type", F.when(F.col("last").isNull(), F.lit("draft")).otherwise(next_node_type(F.col("last")))).drop("last", "n", "notes")
            )
        still = state.join(done, ["task", "subtask"], "left_anti")
        first = Window.partitionBy("task").orderBy("subtask")
        turn = still.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("round", F.lit(number))
        if describe is not None:
            turn = describe(turn).withColumn("description", described(F.col("generated"), F.col("description"))).drop("generated")
        solved = solve(turn)
        solved = solved.withColumn("result", solved_or_error(F.col("result"), F.col("error") if "error" in solved.columns else F.lit(""))).drop("error")
        made = store(critique(solved), f"round-{number}")
        if made.isEmpty():
            break
        log = made if log is None else store(log.unionByName(made), f"log-{number}")
    return log if log is not None else tasks.limit(0)
