"""Chat messages to token samples."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:array<{CALL}>,tool_call_id:string>"
MESSAGES = f"array<{MESSAGE}>"
ROLES = ("system", "user", "assistant", "tool")


def normalised(column: str, kind: T.DataType, default_role: str) -> Column:
    """The canonical array of messages: null is empty, text one message of the default role, a struct one message."""
    c = F.col(column)
    if isinstance(kind, T.StringType):
        one = F.struct(F.lit(default_role).alias("role"), c.alias("content"), F.lit(None).cast(f"array<{CALL}>").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))
        return F.when(c.isNull(), F.array().cast(MESSAGES)).otherwise(F.array(one).cast(MESSAGES))
    if isinstance(kind, T.StructType):
        return F.when(c.isNull(), F.array().cast(MESSAGES)).otherwise(F.array(_message(c, kind)).cast(MESSAGES))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.coalesce(F.transform(c, lambda x: F.struct(F.lit(default_role).alias("role"), x.alias("content"), F.lit(None).cast(f"array<{CALL}>").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))), F.array().cast(MESSAGES)).cast(MESSAGES)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.coalesce(F.transform(c, lambda x: _message(x, kind.elementType)), F.array()).cast(MESSAGES)
    raise TypeError(f"messages can't be read from {kind.simpleString()}")


def _message(c: Column, kind: T.StructType) -> Column:
    has = {f.name for f in kind.fields}
    field = lambda n, t: c[n].cast(t).alias(n) if n in has else F.lit(None).cast(t).alias(n)
    return F.struct(field("role", "string"), field("content", "string"), field("tool_calls", f"array<{CALL}>"), field("tool_call_id", "string"))


def resolved(df: DataFrame, out: str = "chat") -> DataFrame:
    """``messages`` if the column is there and not null, else prompt and completion; without either an error."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = normalised("messages", kinds["messages"], "user") if "messages" in kinds else None
    parts = None
    if "prompt" in kinds and "completion" in kinds:
        parts = F.concat(normalised("prompt", kinds["prompt"], "user"), normalised("completion", kinds["completion"], "assistant"))
    if whole is None and parts is None:
        raise ValueError("needs messages, or prompt and completion")
    if whole is None or parts is None:
        return df.withColumn(out, whole if parts is None else parts)
    return df.withColumn(out, F.when(F.col("messages").isNotNull(), whole).otherwise(parts))


def parsed_arguments(messages: Column, schema: str = "map<string,string>") -> Column:
    """Tool calls of each message with their arguments parsed; a missing text gives null."""
    return F.transform(messages, lambda m: F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), F.from_json(c["function"]["arguments"], schema).alias("arguments"))))


def role_mask(role: Column, trained: tuple[str, ...] = ("assistant",)) -> Column:
    """Whether a role's tokens are trained on; an unknown role is an error."""
    wrong = F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))).cast("boolean")
    return F.when(role.isin(*ROLES), role.isin(*trained)).otherwise(wrong)


def wants_generation_prompt(df: DataFrame, keys: list[str], order: str, role: str = "role") -> DataFrame:
    """A user's or tool's message that an assistant answers."""
    following = F.lead(role).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("generation_prompt", F.col(role).isin("user", "tool") & F.coalesce(following == "assistant", F.lit(False)))


def collapsed_tools(df: DataFrame, keys: list[str], order: str, role: str = "role") -> DataFrame:
    """Of each run of tool messages only the last, which stands for the run."""
    following = F.lead(role).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_next", following).where(~((F.col(role) == "tool") & (F.coalesce(F.col("_next"), F.lit("")) == "tool"))).drop("_next")


#: Rendered tokens that a task holds before it sends them; a longer chat is sent alone.
TOKENS_AT_ONCE = 1 << 18

Renderer = Callable[[list[dict], bool], list[int]]


def render_masked(messages: list[dict], render: Renderer, trained: tuple[str, ...] = ("assistant",)) -> tuple[list[int], list[bool]] | None:
    """Token ids and mask by rendering ever longer prefixes; None where a prefix's tokens change."""
    ids: list[int] = []
    mask: list[bool] = []
    for i, m in enumerate(messages):
        if m["role"] not in ROLES:
            raise ValueError(f"unknown role {m['role']}")
        following = messages[i + 1]["role"] if i + 1 < len(messages) else None
        if m["role"] == "tool" and following == "tool":
            continue
        ask = m["role"] in ("user", "tool") and following == "assistant"
        longer = render(messages[: i + 1], ask)
        if longer[: len(ids)] != ids:
            return None
        mask += [m["role"] in trained] * (len(longer) - len(ids))
        ids = longer
    return ids, mask


def tokenised(df: DataFrame, render: Renderer, column: str = "chat", keep: tuple[str, ...] = (), trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """ids and mask of each row; rows whose rendering isn't stable under longer prefixes are left out."""
    picked = df.select(*keep, F.to_json(column).alias("_chat"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("mask", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, made, held = [], [], 0
            for at, x in enumerate(b.column("_chat")):
                one = render_masked(json.loads(x.as_py()) if x.is_valid else [], render, trained)
                if one is not None:
                    rows.append(at)
                    # packed at once: Python's numbers of a batch would take many times as much
                    made.append((np.array(one[0], np.int64), np.array(one[1], bool)))
                    held += len(one[0])
                if held >= TOKENS_AT_ONCE:
                    yield packed(b, rows, made)
                    rows, made, held = [], [], 0
            if rows:
                yield packed(b, rows, made)

    def packed(b: pa.RecordBatch, rows: list[int], made: list[tuple]) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *[len(i) for i, _ in made]]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([m[k] for m in made]))) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(rows)) for c in keep], *lists], [*keep, "ids", "mask"])

    return picked.mapInArrow(run, schema)


def backfilled(prompt_rendered: Column, full: Column, completion_all_assistant: Column) -> Column:
    """Tokens of a step from its messages: prompt and completion are cut where the two renderings part."""
    from rollsift.functions.arrays import common_prefix_length

    n = common_prefix_length(prompt_rendered, full)
    done = F.slice(full, n + 1, F.greatest(F.size(full) - n, F.lit(0)))
    step = F.struct(
        F.slice(full, F.lit(1), n).alias("prompt_ids"), F.array_repeat(F.lit(False), n).alias("prompt_mask"), done.alias("completion_ids"),
        F.array_repeat(F.lit(True), F.size(done)).alias("completion_mask"), F.array_repeat(F.lit(0.0), F.size(done)).alias("completion_logprobs"),
    )
    return F.when(completion_all_assistant, step)


def offloaded_images(df: DataFrame, url: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows with data URLs replaced by file URLs named by content, the distinct images to write)."""
    data = F.regexp_extract(url, r"^data:image/[^;]+;base64,(.*)$", 1)
    name = F.concat(F.lit(folder.rstrip("/") + "/"), F.substring(F.sha2(data, 256), 1, 16), F.lit(".png"))
    rows = df.withColumn(url, F.when(data != "", F.concat(F.lit("file://"), name)).otherwise(F.col(url)))
    images = df.where(data != "").select(name.alias("path"), F.unbase64(data).alias("content")).dropDuplicates(["path"])
    return rows, images


def flattened_teacher_logprobs(positions: Column) -> Column:
    """First value of each position's map, 0 where there is none."""
    return F.transform(positions, lambda m: F.coalesce(F.try_element_at(F.map_values(m), F.lit(1)), F.lit(0.0)))
