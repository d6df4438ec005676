"""Session streams: events in, each session's records up to its terminal one out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.shipping import ship_package

ITEM = "main_stream_type string, sub_stream_type string, content string, from_sandbox boolean, stream_state string, other_info map<string,string>"


def item(main: str, state: str, content: Column | str = "", sub: str = "", from_sandbox: bool = False) -> Column:
    """A stream item of the given kind; state is start, running or end."""
    text = content if isinstance(content, Column) else F.lit(content)
    return F.struct(F.lit(main).alias("main_stream_type"), F.lit(sub).alias("sub_stream_type"), text.cast("string").alias("content"), F.lit(from_sandbox).alias("from_sandbox"),
                    F.lit(state).alias("stream_state"), F.create_map().cast("map<string,string>").alias("other_info"))


def start_item() -> Column:
    return item("session", "start")


def tool_start_item(name: Column | str) -> Column:
    return item("tool_call", "start", name, from_sandbox=True)


def tool_result_item(result: Column | str) -> Column:
    return item("tool_result", "end", result, sub="tool", from_sandbox=True)


def code_result_item(result: Column | str) -> Column:
    return item("code_result", "running", result, from_sandbox=True)


def end_item() -> Column:
    return item("session", "end")


def open_sessions(events: DataFrame, session: str, seq: str, value: str, terminal: str) -> DataFrame:
    """session, seq, value of each session's events up to its terminal one, that one included; later ones are dropped.

    events may be a stream. A session's state is one flag, kept until a reset: a row whose `reset` column, if there is
    one, is true, which itself is not passed on. Within a micro-batch seq gives the order.
    """
    kind = lambda c: events.schema[c].dataType.simpleString()
    has_reset = "reset" in events.columns
    ship_package(events.sparkSession)

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = bool(state.exists and state.get[0])
        rows = pd.concat(list(batches)).sort_values(seq, kind="stable")  # one session's events of one micro-batch
        end = rows[terminal].fillna(False).astype(bool)
        reset = rows["reset"].fillna(False).astype(bool) if has_reset else pd.Series(False, rows.index)
        part = reset.cumsum().to_numpy()  # a reset begins a new part; the flag from before holds for part 0
        ends = end.astype(int).groupby(part).cumsum()
        ended = (ends - end.astype(int) > 0).to_numpy() | ((part == 0) & before)
        state.update((bool(ends.iloc[-1] > 0 or (part[-1] == 0 and before)),))
        out = rows[~reset.to_numpy() & ~ended]
        yield pd.DataFrame({session: out[session], seq: out[seq], value: out[value]})

    chosen = events.select(session, seq, value, terminal, *(["reset"] if has_reset else []))
    return chosen.groupBy(session).applyInPandasWithState(walk, f"{session} {kind(session)}, {seq} {kind(seq)}, {value} {kind(value)}", "ended boolean", "append", GroupStateTimeout.NoTimeout)


def session_status(requests: DataFrame, live: DataFrame, session: str, create: bool) -> DataFrame:
    """requests with status: live where the session is there; else created, where sessions are made on demand, or missing."""
    known = live.select(F.col(session).alias("_known")).distinct()
    found = requests.join(known, requests[session] == F.col("_known"), "left")
    return found.withColumn("status", F.when(F.col("_known").isNotNull(), F.lit("live")).otherwise(F.lit("created" if create else "missing"))).drop("_known")


def run_available(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and return its rows from memory; each is read once for a checkpoint."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append all that is there now to Parquet files below out; what a checkpoint has seen is not read again."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
