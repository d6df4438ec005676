"""Calls to the outside (models, search, pages) as table functions over a pluggable callable, with retries and replay."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.jsonx import parse_page_answer
from quillspark.functions.text import FALLBACK_CHUNK_CHARS, first_chunk, html_to_text, join_pages
from quillspark.operators.records import is_pdf, require_all, route_page

PAGE_BYTES = 2 * 1024 * 1024  # most bytes of a page that are read
FAILED_SCORE = -1.0


def with_retries(call: Callable[[str], str], attempts: int = 4, pause: float = 1.0) -> Callable[[str], str | None]:
    """call, tried again after each exception; None when all attempts fail. Apart from Spark's own task retries."""

    def run(x: str) -> str | None:
        for n in range(attempts):
            try:
                return call(x)
            except Exception:  # noqa: BLE001  whatever a client raises
                if n + 1 < attempts:
                    time.sleep(pause)
        return None

    return run


def complete(prompts: DataFrame, prompt: str, call: Callable[[str], str], reply: str = "reply", attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """prompts with a model's reply to each, null where all attempts failed."""
    ask = with_retries(call, attempts, pause)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(ask)

    return prompts.withColumn(reply, run(F.col(prompt)))


def with_timeout(call: Callable[[str], str], seconds: float) -> Callable[[str], str]:
    """call, or TimeoutError when it takes longer; the call itself goes on in its thread."""

    def run(x: str) -> str:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(call, x).result(seconds)
        finally:
            pool.shutdown(wait=False)

    return run


def with_rate(call: Callable[[str], str], per_second: float) -> Callable[[str], str]:
    """call, begun at most so often in each Python worker."""
    last = [0.0]

    def run(x: str) -> str:
        wait = last[0] + 1 / per_second - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        last[0] = time.monotonic()
        return call(x)

    return run


def complete_with_fallback(prompts: DataFrame, prompt: str, calls: list[Callable[[str], str]], failed: str | None = None, reply: str = "reply", attempts: int = 1, pause: float = 0.0) -> DataFrame:
    """prompts with the reply of the first model that gives one; `failed` where none does, also for a null prompt."""
    asks = [with_retries(c, attempts, pause) for c in calls]

    def first(x: str | None) -> str | None:
        for ask in asks if x is not None else ():
            if (answer := ask(x)) is not None:
                return answer
        return failed

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(first)

    return prompts.withColumn(reply, run(F.col(prompt)))


def call_models(calls: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """Calls with their model's settings; a model that isn't there is an error."""
    return require_all(calls, models, model)


def pdf_text(files: DataFrame, body: str, pages: Callable[[bytes], list[str]], out: str = "page_text") -> DataFrame:
    """files with the text of their PDF bodies: pages(bytes), which the caller brings, joined; null where it fails."""

    def read(data: bytes | None) -> list[str] | None:
        try:
            return None if data is None else list(pages(bytes(data)))
        except Exception:  # noqa: BLE001  whatever a reader raises
            return None

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(read)

    return files.withColumn(out, join_pages(run(F.col(body))))


def prompt_key(c: Column | str) -> Column:
    return F.sha2(c if isinstance(c, Column) else F.col(c), 256)


def replay(prompts: DataFrame, prompt: str, recorded: DataFrame, reply: str = "reply") -> DataFrame:
    """prompts with the replies recorded(prompt_key, reply) for them: deterministic and offline."""
    known = recorded.select(F.col("prompt_key").alias("_key"), F.col("reply").alias(reply))
    return prompts.join(known, prompt_key(prompt) == F.col("_key"), "left").drop("_key")


def fetch_text(pages: DataFrame, url: str, direct: str, fallback: str | None = None, unclosed: bool = True) -> DataFrame:
    """pages with route (pdf or html), body (the direct fetch or else the fallback, at most 2 MiB) and page_text.

    A PDF has no text here, as no PDF reader is at hand. unclosed: as for html_text().
    """
    body = F.coalesce(F.col(direct), F.col(fallback)) if fallback else F.col(direct)
    capped = F.make_valid_utf8(F.substring(F.encode(body, "UTF-8"), 1, PAGE_BYTES).cast("string"))
    out = pages.withColumn("route", route_page(F.col(url))).withColumn("body", capped)
    return out.withColumn("page_text", F.when((F.col("route") == "html") & ~is_pdf(F.col(url), F.col("body")), html_to_text("body", unclosed)))


def read_and_ask(pages: DataFrame, url: str, direct: str, question: str, ask: Callable[[DataFrame, str], DataFrame], model_chars: int = FALLBACK_CHUNK_CHARS) -> DataFrame:
    """Fetch, text, first window, prompt, answer: adds answer (content, urls, score, raw); score is -1 where the page or the reply is missing.

    ask(frame, prompt column) adds reply, by complete() or replay().
    """
    rows = fetch_text(pages, url, direct).withColumn("_window", first_chunk("page_text", model_chars))
    prompt = F.when(F.col("_window").isNotNull(), F.concat(F.lit("Question: "), F.col(question), F.lit("\n\nPage:\n"), F.col("_window")))
    asked = ask(rows.withColumn("_prompt", prompt), "_prompt")
    answer = parse_page_answer("reply")
    nothing = F.struct(F.lit("").alias("content"), F.array().cast("array<struct<url:string,description:string>>").alias("urls"), F.lit(FAILED_SCORE).alias("score"), F.lit(None).cast("string").alias("raw"))
    return asked.withColumn("answer", F.when(F.col("reply").isNull(), nothing).otherwise(answer)).drop("_window", "_prompt")


def search_hits(envelopes: DataFrame, by: list[str], envelope: str, k: int = 10) -> DataFrame:
    """title, link, snippet, text of the first k hits of each answer, which is a list or an object with `organic`; items that are no objects go after the cut."""
    doc = F.col(envelope)
    items = F.from_json(F.when(F.ltrim(doc).startswith("["), doc).otherwise(F.get_json_object(doc, "$.organic")), "array<string>")
    hits = envelopes.select(*by, F.posexplode(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, k)).alias("rank", "item"))
    get = lambda n: F.coalesce(F.get_json_object("item", f"$.{n}"), F.lit(""))
    return hits.where(F.ltrim("item").startswith("{")).select(*by, "rank", get("title").alias("title"), get("link").alias("link"), get("snippet").alias("snippet"), get("snippet").alias("text"))
