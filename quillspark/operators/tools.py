"""Tool calls: registry, agents' tool sets and the bounded tool loop."""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.records import with_safe_tool_name


@dataclass
class Tool:
    """A callable with its JSON schema; column functions register in Spark too."""

    name: str
    description: str
    schema: dict
    run: Callable[..., object]


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        """A later tool of a name replaces the earlier; - and _ are the same."""
        self.tools[tool.name.replace("-", "_")] = tool

    def call(self, name: str, arguments: str) -> str:
        """The tool's answer as text; a missing tool and an error are text too."""
        tool = self.tools.get(name.replace("-", "_"))
        if tool is None:
            return f"tool {name} is not implemented"
        try:
            given = json.loads(arguments or "{}")
        except ValueError:
            given = {"_raw": arguments}
        try:
            answer = tool.run(**given)
        except Exception:  # noqa: BLE001  whatever a tool raises is shown to the model
            return traceback.format_exc()
        return answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False, default=str)

    def frame(self, spark: SparkSession) -> DataFrame:
        """name, tool_key, description, schema of all tools."""
        return spark.createDataFrame([(t.name, k, t.description, json.dumps(t.schema)) for k, t in self.tools.items()], "name string, tool_key string, description string, schema string")


# The tools' names, each argument's name and type, and which must be given.
TOOL_ARGUMENTS = {
    "Python_code_interpreter": ({"code": "string"}, ("code",)),
    "load_skill_specs": ({"skill_names": "array"}, ("skill_names",)),
    "library_search": ({"query": "string", "top_k": "integer"}, ("query",)),
    "library_parse": ({"link": "string", "user_prompt": "string", "llm": "string"}, ("link", "user_prompt")),
    "prior_search": ({"query": "string", "top_k": "integer", "expand_context": "boolean", "return_format": "string", "source_ids": "array",
                      "chapter": "string", "section_prefix": "string", "keywords": "array", "rewrite_query": "boolean"}, ("query",)),
}
# The tools of each role; the second list is added where the library is on, the third where prior search is.
ROLE_TOOLS = {
    "solver": (("Python_code_interpreter", "load_skill_specs"), ("library_search", "library_parse"), ()),
    "critic": ((), ("library_search", "library_parse"), ("prior_search",)),
    "supervisor": ((), ("library_search", "library_parse"), ("prior_search",)),
}


def tool_schema(name: str) -> dict:
    """The JSON schema of a known tool's arguments."""
    arguments, needed = TOOL_ARGUMENTS[name]
    kinds = {"array": {"type": "array", "items": {"type": "string"}}}
    return {"type": "object", "properties": {k: kinds.get(t, {"type": t}) for k, t in arguments.items()}, "required": list(needed)}


def role_tools(role: str, library: bool = True, prior: bool = True) -> list[str]:
    """The names of the tools that a role may call."""
    own, with_library, with_prior = ROLE_TOOLS[role]
    return [*own, *(with_library if library else ()), *(with_prior if prior else ())]


def tool_frame(spark: SparkSession) -> DataFrame:
    """role, tool, pos, schema of every role's tools."""
    rows = [(role, tool, pos, json.dumps(tool_schema(tool))) for role in ROLE_TOOLS for pos, tool in enumerate(role_tools(role))]
    return spark.createDataFrame(rows, "role string, tool string, pos int, schema string")


def tool_catalog(spark: SparkSession, servers: list[str], list_tools: Callable[[str], list[dict]]) -> DataFrame:
    """server_pos, server, kind, name, tool_key and description of every server's tools; a server that fails is left out.

    list_tools gives a server's tools as {"name", "description"}; it is called on the driver, once for each server.
    """
    rows = []
    for pos, server in enumerate(servers):
        try:
            found = list_tools(server)
        except Exception:  # noqa: BLE001  whatever a connection raises
            continue
        rows += [(pos, server, t["name"], t.get("description") or "") for t in found]
    out = spark.createDataFrame(rows, "server_pos int, server string, name string, description string")
    return with_safe_tool_name(out, "name").select("server_pos", "server", server_kind("server").alias("kind"), "name", "tool_key", "description")


def server_kind(c: Column | str) -> Column:
    """How a server is reached: a .py or .js file is run and spoken to by its standard streams, an address by events over HTTP; null for others."""
    c = c if isinstance(c, Column) else F.col(c)
    return F.when(c.endswith(".py"), F.lit("python")).when(c.endswith(".js"), F.lit("node")).when(c.startswith("http"), F.lit("http"))


def tool_loop(model: Callable[[list[dict]], dict], registry: Registry, system: str, user: str, turns: int = 20) -> str:
    """Messages to and fro until the model calls no tool; its latest filled text when the turns run out.

    model gets all messages and returns {"content": text, "tool_calls": [{"id", "name", "arguments"}]}.
    """
    messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    for _ in range(turns):
        reply = model(messages)
        calls = reply.get("tool_calls") or []
        messages.append({"role": "assistant", "content": reply.get("content") or "", "tool_calls": calls})
        if not calls:
            return messages[-1]["content"]
        messages += [{"role": "tool", "tool_call_id": c["id"], "content": registry.call(c["name"], c.get("arguments") or "")} for c in calls]
    return next((m["content"] for m in reversed(messages) if m["role"] == "assistant" and m["content"].strip()), "")


def tool_loops(rows: DataFrame, system: str, user: str, model: Callable[[list[dict]], dict], registry: Callable[[], Registry], turns: int = 20, out: str = "answer") -> DataFrame:
    """rows with the answer of a tool_loop() for each; registry() makes each worker's tools."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tools = registry()
        for systems, users in batches:
            yield pd.Series([tool_loop(model, tools, s or "", u or "", turns) for s, u in zip(systems, users)])

    return rows.withColumn(out, run(F.col(system), F.col(user)))
