"""Lenient JSON: candidates from a model's reply, tried in order."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip

# Fixed value: a fenced block, with or without the language's name.
FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)
FENCE_JVM = r"(?is)```(?:json)?\s*(.*?)```"


def _between(text: str, first: str, last: str) -> str | None:
    a, b = text.find(first), text.rfind(last)
    return text[a:b + 1] if 0 <= a < b else None


def candidates(text: str, arrays: bool = True, every_fence: bool = True) -> list[str]:
    """The text itself, its fenced blocks, from the first { to the last }, from the first [ to the last ]."""
    fences = [m.strip() for m in FENCE.findall(text)]
    out = [text.strip(), *(fences if every_fence else fences[:1]), _between(text, "{", "}")]
    return [c for c in (*out, _between(text, "[", "]") if arrays else None) if c]


def extract(text: str | None, arrays: bool = True, every_fence: bool = True):
    """The first candidate that is JSON, else None and False; a JSON null counts."""
    for c in candidates(text or "", arrays, every_fence):
        try:
            return json.loads(c), True
        except ValueError:
            continue
    return None, False


def extract_json(c: Column | str, arrays: bool = True, every_fence: bool = True, otherwise: str | None = "{}") -> Column:
    """The extracted value as compact JSON text, exact as Python parses it; `otherwise` where nothing parses."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            value, ok = extract(text, arrays, every_fence)
            return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if ok else otherwise

        return texts.map(one)

    return run(c if isinstance(c, Column) else F.col(c))


def extract_json_native(c: Column | str, arrays: bool = True, otherwise: str | None = "{}") -> Column:
    """The same in the JVM. Spark's parser differs at the edges: it ignores text behind the first value and rejects NaN."""
    c = c if isinstance(c, Column) else F.col(c)
    parse = lambda x: F.to_json(F.try_parse_json(x))
    between = lambda a, b: F.when((F.locate(a, c) > 0) & (F.locate(b, F.reverse(c)) > 0),
                                  F.substring(c, F.locate(a, c), F.length(c) - F.locate(b, F.reverse(c)) + 2 - F.locate(a, c)))
    fenced = F.regexp_extract_all(c, F.lit(FENCE_JVM), F.lit(1))
    first_fence = F.try_element_at(F.filter(F.transform(fenced, parse), lambda x: x.isNotNull()), F.lit(1))
    steps = [parse(F.trim(c)), first_fence, parse(between("{", "}"))] + ([parse(between("[", "]"))] if arrays else [])
    return F.coalesce(*steps, F.lit(otherwise))


def extract_contract(c: Column | str) -> Column:
    """Objects only; a reply without one becomes {"raw_output": text, "error": reason}."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str:
            for x in (text or "", _between(text or "", "{", "}")):
                try:
                    value = json.loads(x or "")
                    if isinstance(value, dict):
                        return json.dumps(value, ensure_ascii=False)
                except ValueError:
                    continue
            return json.dumps({"raw_output": text or "", "error": "no JSON object in the reply"}, ensure_ascii=False)

        return texts.map(one)

    return run(c if isinstance(c, Column) else F.col(c))


def parse_page_answer(c: Column | str) -> Column:
    """struct(content, urls, score, raw): a reply's object, or where there is none the stripped text behind </think>, or else the text as it is, as raw.

    \\( and \\) are escaped once more before parsing. Missing keys: content '', no urls, score 0.0; raw text: score 0.5.
    """

    @F.pandas_udf("content string, urls array<struct<url: string, description: string>>, score double, raw string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            piece = _between(text or "", "{", "}")
            try:
                value = json.loads((piece or "").replace("\\(", "\\\\(").replace("\\)", "\\\\)"))
            except ValueError:
                value = None
            if isinstance(value, dict):
                urls = [{"url": str(u.get("url", "")), "description": str(u.get("description", ""))} for u in value.get("urls") or [] if isinstance(u, dict)]
                try:
                    score = float(value.get("score", 0.0))
                except (TypeError, ValueError):
                    score = 0.0
                rows.append((str(value.get("content", "")), urls, score, None))
            else:
                _, thought, tail = (text or "").rpartition("</think>")
                plain = tail.strip() if thought else text or ""
                rows.append((plain, [], 0.5, plain))
        return pd.DataFrame(rows, columns=["content", "urls", "score", "raw"])

    return run(c if isinstance(c, Column) else F.col(c))


def tool_arguments(c: Column | str) -> Column:
    """Arguments of a tool call as JSON text; text that isn't JSON becomes {"_raw": text}, a missing one {}."""
    c = c if isinstance(c, Column) else F.col(c)
    return F.coalesce(F.to_json(F.try_parse_json(F.coalesce(F.nullif(c, F.lit("")), F.lit("{}")))), F.to_json(F.struct(c.alias("_raw"))))


def parse_or_text(c: Column | str) -> Column:
    """struct(json, text): the value as compact JSON text where the text is JSON, else the text itself; one of the two is null, both for null."""
    c = c if isinstance(c, Column) else F.col(c)
    value = F.to_json(F.try_parse_json(F.when(strip(c) != "", c)))
    return F.struct(value.alias("json"), F.when(value.isNull(), c).alias("text"))


def flatten(value) -> str:
    """Natural text of any JSON value: items joined by spaces, fields as `key: text` by semicolons, empty ones dropped."""
    if value is None:
        return ""
    if isinstance(value, dict):
        return "; ".join(f"{k}: {t}" for k, v in value.items() if (t := flatten(v))).strip()
    if isinstance(value, list):
        return " ".join(t for v in value if (t := flatten(v))).strip()
    return str(value).strip()


def flatten_json(c: Column | str) -> Column:
    """flatten() of JSON text of any depth; text that isn't JSON is itself, stripped."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str:
            try:
                return flatten(json.loads(text))
            except (TypeError, ValueError):
                return (text or "").strip()

        return texts.map(one)

    return run(c if isinstance(c, Column) else F.col(c))


def to_reward(c: Column) -> Column:
    """A double, or 0.0 for null, text that is no number, and NaN, which must never win a comparison."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def to_integer(c: Column) -> Column:
    return c.try_cast("int")


# Decisions and the verdict each stands for.
VERDICTS = {"complete": "accept", "to_revise": "refine", "to_redraft": "reject"}


def to_decision(c: Column) -> Column:
    """One of the decisions, without case and white space; anything else is to_revise."""
    d = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(d.isin(*VERDICTS), d).otherwise(F.lit("to_revise"))


def to_verdict(decision: Column, given: Column | None = None) -> Column:
    """The given verdict if it is filled, else the decision's."""
    own = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])[decision]
    return own if given is None else F.coalesce(F.nullif(given, F.lit("")), own)


def next_node_type(decision: Column) -> Column:
    return F.when(decision == "to_redraft", F.lit("draft")).otherwise(F.lit("revise"))
