"""Chat requests as tables: text segments out of messages and JSON, and back."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.functions.arrow import ROWS, lists

PARTS = ("text", "image_url", "tool_use", "tool_result", "input_audio", "file", "refusal")
#: Top-level keys of a request that are understood.
REQUEST_KEYS = ["model", "messages", "stream", "system", "max_tokens", "temperature", "tools", "user", "metadata"]


def runs(rows: DataFrame, keys: list[str], order: str, same: Column) -> DataFrame:
    """Numbers the maximal runs of neighbouring rows with an equal ``same``."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.coalesce((same != F.lag(same).over(w)), F.lit(True)).cast("int")
    return rows.withColumn("__fresh", fresh).withColumn("run", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def coalesce_text(parts: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Neighbouring text parts as one segment (its place is the first one's); other parts are left out."""
    marked = runs(parts, keys, order, F.col("type") == "text").filter("type = 'text'")
    pieces = marked.groupBy(*keys, "run").agg(F.min(order).alias("first_pos"), F.array_sort(F.collect_list(F.struct(order, "text"))).alias("p"))
    return pieces.select(*keys, "first_pos", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def unsupported(parts: DataFrame) -> DataFrame:
    """Parts of unknown type: these requests fail closed."""
    return parts.filter(~F.coalesce(F.col("type").isin(*PARTS), F.lit(False)))


def unknown_keys(body: Column, allowed: list[str] | None = None) -> Column:
    return F.array_except(F.json_object_keys(body), F.array(*[F.lit(k) for k in allowed or REQUEST_KEYS]))


_LEAF = pa.struct([("path", pa.string()), ("text", pa.string())])


def _walk(value, path: str, out: list[tuple[str, str]]) -> None:
    if isinstance(value, str):
        out.append((path, value))
    elif isinstance(value, dict):
        for k, v in value.items():
            _walk(v, f"{path}.{k}" if path else k, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _walk(v, f"{path}.{i}" if path else str(i), out)


def json_strings(document: Column) -> Column:
    """Every string of a JSON document with its path; null for invalid JSON."""

    def found(text: str | None) -> list[tuple[str, str]] | None:
        try:
            out: list[tuple[str, str]] = []
            _walk(json.loads(text), "", out)
            return out
        except (TypeError, ValueError):
            return None

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), ROWS):
                yield lists([found(t) for t in texts.slice(at, ROWS).to_pylist()], _LEAF)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<path:string,text:string>>")(document)


def _replace(value, change: Callable[[str], str]):
    if isinstance(value, str):
        return change(value)
    if isinstance(value, dict):
        return {k: _replace(v, change) for k, v in value.items()}
    return [_replace(v, change) for v in value] if isinstance(value, list) else value


def restore_json(document: Column, values: Column) -> Column:
    """Puts values back into the strings of a JSON document, never into its raw text."""
    from maskframe.operators.mask import restore

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, maps in batches:
            rows = []
            for t, m in zip(texts, maps, strict=True):
                known = dict(m) if m is not None else {}
                try:
                    rows.append(json.dumps(_replace(json.loads(t), lambda s, k=known: restore(s, k)), ensure_ascii=False, separators=(",", ":")))
                except (TypeError, ValueError):
                    rows.append(None)
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(document, values)


#: Fields of a request beside its messages that hold text, by the shape of the request (fixed values).
AUXILIARY = {
    "openai": ["metadata", "prediction", "response_format", "stop", "tools", "user", "web_search_options"],
    "anthropic": ["metadata", "stop_sequences", "thinking", "tools"],
}
MESSAGES = "struct<model:string,system:string,messages:array<struct<role:string,name:string,content:string,tool_calls:array<struct<`function`:struct<arguments:string>>>>>>"
_PARTS = "array<struct<type:string,text:string>>"


def _contents(rows: DataFrame, keys: list[str], content: Column, path: Column) -> DataFrame:
    """Segments of contents that are a text or a list of parts."""
    rows = rows.select(*keys, content.alias("content"), path.alias("path")).filter("content is not null")
    is_list = F.coalesce(F.col("content").startswith("["), F.lit(False))
    plain = rows.filter(~is_list).select(*keys, "path", F.col("content").alias("text"))
    parts = rows.filter(is_list).select(*keys, "path", F.posexplode(F.from_json("content", _PARTS)).alias("pos", "part")).select(*keys, "path", "pos", "part.*")
    joined = coalesce_text(parts, [*keys, "path"]).select(*keys, F.format_string("%s.part.%d", "path", "first_pos").alias("path"), "text")
    return plain.unionByName(joined)


def _leaves(rows: DataFrame, keys: list[str], document: Column, path: Column) -> DataFrame:
    """Segments of the strings of JSON documents."""
    found = rows.select(*keys, path.alias("path"), F.explode(json_strings(document)).alias("leaf"))
    return found.select(*keys, F.when(F.col("leaf.path") == "", F.col("path")).otherwise(F.concat_ws(".", "path", "leaf.path")).alias("path"), F.col("leaf.text").alias("text"))


def request_segments(requests: DataFrame, key: str = "req_id", body: str = "body", shape: str = "openai") -> DataFrame:
    """Text segments (req_id, path, text) of chat requests: system, names, contents (neighbouring text parts joined), arguments of tool calls, and auxiliary fields."""
    parsed = requests.select(key, F.from_json(body, MESSAGES).alias("r"))
    messages = parsed.select(key, F.posexplode("r.messages").alias("m", "msg"))
    out = [
        _contents(parsed, [key], F.col("r.system"), F.lit("system")),
        _contents(messages, [key], F.col("msg.content"), F.format_string("messages.%d.content", "m")),
        messages.filter("msg.name is not null").select(key, F.format_string("messages.%d.name", "m").alias("path"), F.col("msg.name").alias("text")),
    ]
    calls = messages.select(key, "m", F.posexplode("msg.tool_calls").alias("t", "call"))
    out.append(_leaves(calls, [key], F.col("call.function.arguments"), F.format_string("messages.%d.tool.%d", "m", "t")))
    extra = requests.select(key, F.explode(json_strings(F.col(body))).alias("leaf")).filter(F.substring_index("leaf.path", ".", 1).isin(AUXILIARY[shape]))
    out.append(extra.select(key, F.concat(F.lit("request."), F.col("leaf.path")).alias("path"), F.col("leaf.text").alias("text")))
    return reduce(DataFrame.unionByName, out)


def response_segments(responses: DataFrame, key: str = "resp_id", body: str = "body", shape: str = "openai") -> DataFrame:
    """Text segments (resp_id, path, text) of whole responses: contents and arguments of tool calls."""
    if shape == "anthropic":
        return _contents(responses, [key], F.get_json_object(body, "$.content"), F.lit("response.content"))
    choices = "struct<choices:array<struct<message:struct<content:string,tool_calls:array<struct<`function`:struct<arguments:string>>>>>>>"
    rows = responses.select(key, F.posexplode(F.from_json(body, choices)["choices"]).alias("c", "choice"))
    calls = rows.select(key, "c", F.posexplode("choice.message.tool_calls").alias("t", "call"))
    return _contents(rows, [key], F.col("choice.message.content"), F.format_string("response.%d.content", "c")).unionByName(_leaves(calls, [key], F.col("call.function.arguments"), F.format_string("response.%d.tool.%d", "c", "t")))


def _in_content(content, change: Callable[[str], str]):
    """A content with its texts changed: a text, or the text and input of parts."""
    if isinstance(content, str):
        return change(content)
    if not isinstance(content, list):
        return content
    out = []
    for part in content:
        if isinstance(part, dict):
            part = dict(part)
            if isinstance(part.get("text"), str):
                part["text"] = change(part["text"])
            if "input" in part:
                part["input"] = _replace(part["input"], change)
            if "content" in part:
                part["content"] = _in_content(part["content"], change)
        out.append(part)
    return out


def _in_response(value: dict, change: Callable[[str], str]) -> dict:
    if isinstance(value.get("content"), list):
        return {**value, "content": _in_content(value["content"], change)}
    for choice in value.get("choices") or []:
        message = choice.get("message") or {}
        if "content" in message:
            message["content"] = _in_content(message["content"], change)
        for call in message.get("tool_calls") or []:
            text = (call.get("function") or {}).get("arguments")
            if isinstance(text, str):
                try:
                    call["function"]["arguments"] = json.dumps(_replace(json.loads(text), change), ensure_ascii=False, separators=(",", ":"))
                except ValueError:
                    call["function"]["arguments"] = change(text)
    return value


def restore_response(body: Column, values: Column) -> Column:
    """A whole response of either shape with values put back into contents and tool arguments, and nowhere else; null for invalid JSON."""
    from maskframe.operators.mask import restore

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, maps in batches:
            rows = []
            for t, m in zip(texts, maps, strict=True):
                known = dict(m) if m is not None else {}
                try:
                    rows.append(json.dumps(_in_response(json.loads(t), lambda s, k=known: restore(s, k)), ensure_ascii=False, separators=(",", ":")))
                except (TypeError, ValueError, AttributeError):
                    rows.append(None)
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(body, values)


def unanswered(items: DataFrame, segments: DataFrame, key: str, item: str = "id") -> DataFrame:
    """Items of a detection answer that name no segment of their request; an answer is whole if there are none."""
    return items.select(key, item).join(segments.select(key, item), [key, item], "left_anti")


def block_fields(frames: DataFrame, data: str = "data", resp_id: str = "resp_id") -> DataFrame:
    """Text and tool-input deltas of the block-wise stream shape, as chunks (resp_id, field_key, seq, text, fmt)."""
    shape = "struct<index:int,delta:struct<type:string,text:string,partial_json:string>>"
    rows = frames.select(resp_id, "seq", F.from_json(data, shape).alias("f")).filter("f.index is not null")
    is_text = F.coalesce((F.col("f.delta.type") == "text_delta") & F.col("f.delta.text").isNotNull(), F.lit(False))
    is_json = F.coalesce((F.col("f.delta.type") == "input_json_delta") & F.col("f.delta.partial_json").isNotNull(), F.lit(False))
    return rows.filter(is_text | is_json).select(
        F.col(resp_id).alias("resp_id"),
        F.format_string("block.%d.%s", "f.index", F.when(is_text, F.lit("text")).otherwise(F.lit("input"))).alias("field_key"),
        "seq",
        F.when(is_text, F.col("f.delta.text")).otherwise(F.col("f.delta.partial_json")).alias("text"),
        F.when(is_text, F.lit("text")).otherwise(F.lit("json")).alias("fmt"),
    )


def delta_fields(frames: DataFrame, data: str = "data") -> DataFrame:
    """Content and tool-argument fields of stream frames, as chunks (resp_id, field_key, seq, text, fmt)."""
    shape = "struct<id:string,choices:array<struct<index:int,delta:struct<content:string,tool_calls:array<struct<index:int,`function`:struct<arguments:string>>>>>>>"
    rows = frames.select(F.col("seq"), F.from_json(data, shape).alias("f")).select("seq", F.col("f.id").alias("resp_id"), F.explode("f.choices").alias("c"))
    text = rows.filter("c.delta.content is not null").select("resp_id", F.format_string("choice.%d.content", "c.index").alias("field_key"), "seq", F.col("c.delta.content").alias("text"), F.lit("text").alias("fmt"))
    calls = rows.select("resp_id", "seq", F.col("c.index").alias("i"), F.explode("c.delta.tool_calls").alias("t")).select("resp_id", F.format_string("choice.%d.tool.%d", "i", "t.index").alias("field_key"), "seq", F.col("t.function.arguments").alias("text"), F.lit("json").alias("fmt"))
    return text.unionByName(calls)
