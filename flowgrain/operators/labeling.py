"""Labels from a language model: prompts, replies, and what is done when a reply is of no use.

The model is any callable (system, user) -> reply or None that can be sent to the workers; each partition makes its own
through a factory. There is one prompt per function. Without a factory all labels come by rule.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrain.functions.labels import first_json_object, full_signature

#: Code shown per node, and the longest label.
SHOWN, LONGEST = 300, 300
UNLABELLED = ("START", "END")
Client = Callable[[str, str], "str | None"]

SYSTEM = """You label the nodes of a chart of C++ code for technical documentation.
Say in plain, short English what each node does: questions for decisions and loops, imperatives for steps.
Keep the names of functions as they are and add nothing that is not in the code.
Answer only with one JSON object that maps every node_id to its label."""


def node_records(nodes: DataFrame, calls: DataFrame | None = None, comments: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """`function_key`, `nodes_json`, `node_ids`: what a prompt shows of each node that gets a label.

    calls (function_key, node_id, ord, signature, description), comments (function_key, node_id, comment) and symbols
    (function_key, node_id, kind, summary; kinds enum_context, macro_context, typedef_context) may be added.
    """
    own = nodes.where(~F.col("node_type").isin(*UNLABELLED)).dropDuplicates(["function_key", "node_id"])
    on = ["function_key", "node_id"]
    fields = [F.col("node_id"), F.col("node_type").alias("type"), F.substring("raw_code", 1, SHOWN).alias("raw_code")]
    if calls is not None:
        text = F.when(F.col("description") != "", F.concat_ws(": ", "signature", "description")).otherwise(F.col("signature"))
        own = own.join(calls.groupBy(on).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]).alias("called_functions")), on, "left")
        fields.append(F.col("called_functions"))
    if comments is not None:
        own = own.join(comments.where("comment != ''").groupBy(on).agg(F.min("comment").alias("source_comment")), on, "left")
        fields.append(F.col("source_comment"))
    if symbols is not None:
        for kind in ("enum_context", "macro_context", "typedef_context"):
            own = own.join(symbols.where(F.col("kind") == kind).groupBy(on).agg(F.array_sort(F.collect_set("summary")).alias(kind)), on, "left")
            fields.append(F.col(kind))
    listed = F.array_sort(F.collect_list(F.struct("node_seq", F.struct(*fields).alias("n"))))
    return own.groupBy("function_key").agg(listed.alias("l")).select("function_key", F.to_json(F.transform("l", lambda x: x["n"])).alias("nodes_json"), F.transform("l", lambda x: x["n"]["node_id"]).alias("node_ids"))


# The headings and the last line of a prompt, as prompts are read by models that were tuned to them.
HEAD_CONTEXT, HEAD_SOURCE, HEAD_NODES = "\n--- Project Context ---\n", "\n--- Function Source Code ---\n", "\n--- Nodes to Label ---\n"
LAST_LINE = "\nReturn ONLY the JSON object mapping each node_id to its label."


def context_text(parameters: Column, types: Column, purpose: Column, callees: Column) -> Column:
    """The context of a function, part by part, without empty parts."""
    part = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(title), body))
    return F.concat_ws("\n", part("Parameters: ", parameters), part("Parameter type context:\n", types), part("Purpose: ", purpose), part("Called functions context:\n", callees))


def prompt(qualified_name: Column, params: Column, purpose: Column, context: Column, source: Column, nodes_json: Column) -> Column:
    """The prompt of one function."""
    part = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(title), body))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Function: "), full_signature(qualified_name, params)),
        part("Purpose: ", purpose),
        part(HEAD_CONTEXT, context),
        F.concat(F.lit(HEAD_SOURCE), F.coalesce(source, F.lit(""))),
        F.concat(F.lit(HEAD_NODES), nodes_json),
        F.lit(LAST_LINE),
    )


def reply_error(reply: Column, node_ids: Column) -> Column:
    """What is wrong with a reply, the first of: no object, no JSON, missing ids, a label that is no text, blank or too long; null if nothing is."""

    def wrong(r: Column) -> Column:
        labels = F.from_json(r, "map<string,string>")
        texts = F.from_json(r, "map<string,variant>")
        missing = F.array_sort(F.array_except(node_ids, F.coalesce(F.map_keys(labels), F.array().cast("array<string>"))))
        first = lambda a, text: F.transform(F.array(F.array_sort(a)), lambda x: F.when(F.size(x) > 0, F.concat(F.lit(text), F.get(x, F.lit(0)))))[0]
        keys = lambda m, bad: F.map_keys(F.map_filter(m, lambda _, v: bad(v)))
        return F.coalesce(
            F.when(r.isNull(), "no JSON object"),
            F.when(F.try_parse_json(r).isNull(), "JSON parse error"),
            F.transform(F.array(missing), lambda x: F.when(F.size(x) > 0, F.concat(F.lit("missing ids: "), F.array_join(x, ", "))))[0],
            first(keys(texts, lambda v: F.schema_of_variant(v) != "STRING"), "not a text: "),
            first(keys(labels, lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), r"(?U)\s", "") == ""), "empty label: "),
            first(keys(labels, lambda v: F.length(v) > LONGEST), "too long: "),
        )

    return F.transform(F.array(first_json_object(reply)), wrong)[0]


def reply_labels(replies: DataFrame) -> DataFrame:
    """`function_key`, `node_id`, `label` of the replies (function_key, reply, node_ids) that are in order."""
    good = replies.withColumn("error", reply_error(F.col("reply"), F.col("node_ids"))).where("error is null")
    return good.select("function_key", F.explode(F.from_json(first_json_object(F.col("reply")), "map<string,string>")).alias("node_id", "label")).withColumn("label", F.regexp_replace("label", r"(?U)^\s+|\s+$", ""))


def first_object(reply: str) -> str | None:
    """The first `{` to the bracket that closes it, as `first_json_object` finds it."""
    bare = re.sub(r"```(?:json)?\s*", "", reply).replace("```", "")
    start, depth = bare.find("{"), 0
    for m in re.finditer("[{}]", bare[start:] if start >= 0 else ""):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return bare[start : start + m.end()]
    return None


def ask(prompts: DataFrame, factory: Callable[[], Client], retries: int = 2) -> DataFrame:
    """`function_key`, `reply`, `node_ids`: asks for each (function_key, prompt, node_ids), again with a note where a reply lacks ids.

    A reply that is never in order comes out as null, so that all nodes of the function get their labels by rule.
    """

    def usable(reply: str | None, ids: list[str]) -> str:
        try:
            data = json.loads(first_object(reply or "") or "null")
        except ValueError:
            return "no JSON object"
        if not isinstance(data, dict):
            return "no JSON object"
        lost = sorted(set(ids) - set(data))
        bad = [k for k, v in data.items() if not isinstance(v, str) or not v.strip() or len(v) > LONGEST]
        return f"missing ids {lost}" if lost else f"unusable labels {bad}" if bad else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for b in batches:
            replies = []
            for text, ids in zip(b["prompt"], b["node_ids"]):
                note, reply = "", None
                for _ in range(retries + 1):
                    reply = client(SYSTEM, text + note)
                    error = usable(reply, list(ids))
                    if not error:
                        break
                    note, reply = f"\nYour last answer could not be used: {error}.", None
                replies.append(reply)
            yield pd.DataFrame({"function_key": b["function_key"], "reply": replies, "node_ids": b["node_ids"]})

    return prompts.select("function_key", "prompt", "node_ids").mapInPandas(run, "function_key string, reply string, node_ids array<string>")


def apply_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes with the labels found for them; unknown ids are passed over, other nodes keep theirs."""
    new = labels.groupBy("function_key", "node_id").agg(F.min("label").alias("new_label"))
    return nodes.join(new, ["function_key", "node_id"], "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")


def http_client(url: str, model: str, chat: bool = False, timeout: float = 120, temperature: float = 0.1, tokens: int = 2048) -> Callable[[], Client]:
    """A factory of clients of a model server, in its plain or in its chat form; every failure is a None."""

    def factory() -> Client:
        def call(system: str, user: str) -> str | None:
            if chat:
                body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature, "max_tokens": tokens}
            else:
                body = {"model": model, "system": system, "prompt": user, "stream": False, "options": {"temperature": temperature, "top_p": 0.9, "num_predict": tokens}}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    data = json.load(answer)
                text = data["choices"][0]["message"]["content"] if chat else data.get("response")
            except (OSError, ValueError, KeyError, IndexError, TypeError):
                return None
            return text or None

        return call

    return factory
