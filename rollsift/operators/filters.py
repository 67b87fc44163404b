"""Degenerate-output filters, validation rules and retention predicates."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollsift.functions.scalars import HASH_BITS, hash_number
from rollsift.operators.selection import smallest

# Defaults of the filters.
TOKEN_ID_THRESHOLD = 100_000
LOGPROB_OFFSET = 2.0
REPETITION_WINDOW = 3_000
REPETITION_PROBABILITY = 0.99


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gibberish_threshold(vocab: int, offset: float = LOGPROB_OFFSET) -> float:
    """Log probability under which a rare token counts: under uniform by ``offset``."""
    return -math.log(vocab) - offset


def gibberish_index(ids, logprobs, vocab: int, min_id: int = TOKEN_ID_THRESHOLD, offset: float = LOGPROB_OFFSET) -> Column:
    """0-based index of the first rare and unlikely token; null if none.

    ids, logprobs: arrays of steps' arrays; steps with null ids are skipped and don't count."""
    limit = F.lit(gibberish_threshold(vocab, offset))
    hits = F.zip_with(F.flatten(F.filter(_c(ids), lambda s: s.isNotNull())), F.flatten(F.filter(_c(logprobs), lambda s: s.isNotNull())), lambda i, p: (i > min_id) & (p < limit))
    at = F.array_position(hits, F.lit(True))
    return F.when(at > 0, (at - 1).cast("long"))


def repetition_index(logprobs, window: int = REPETITION_WINDOW, probability: float = REPETITION_PROBABILITY) -> Column:
    """0-based index at which a run of ``window`` tokens over ``probability`` is complete; null if none.

    Runs continue over steps. One pass: the state is the position, the run so far and the hit."""
    limit = F.lit(math.log(probability))
    flat = F.flatten(F.filter(_c(logprobs), lambda s: s.isNotNull()))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(-1).alias("hit"))

    def step(acc: Column, p: Column) -> Column:
        run = F.when(p > limit, acc["run"] + 1).otherwise(0)
        hit = F.when((acc["hit"] < 0) & (run >= window), acc["at"]).otherwise(acc["hit"])
        return F.struct((acc["at"] + 1).alias("at"), run.alias("run"), hit.alias("hit"))

    hit = F.aggregate(flat, start, step, lambda acc: acc["hit"])
    return F.when(hit >= 0, hit.cast("long"))


def zero_advantage(advantage) -> Column:
    """The advantage is exactly 0; null isn't."""
    return F.coalesce(_c(advantage) == 0.0, F.lit(False))


@dataclass(frozen=True)
class RolloutFilter:
    """A named condition; ``enforce`` false only marks."""

    name: str
    detected: Column
    enforce: bool = True


def apply_filters(df: DataFrame, filters: list[RolloutFilter], hit: str = "filter_hit", dropped: str = "is_filtered") -> DataFrame:
    """The first filter that detects names the hit, and it alone decides: a mark shadows later filters."""
    case = F.lit(None).cast("string")
    for f in reversed(filters):
        case = F.when(f.detected, F.lit(f.name)).otherwise(case)
    enforced = [f.name for f in filters if f.enforce]
    return df.withColumn(hit, case).withColumn(dropped, F.coalesce(F.col(hit).isin(enforced), F.lit(False)) if enforced else F.lit(False))


def sample_problem(seq_len: int) -> Column:
    """Why a sample can't be packed, by the first rule it breaks; null if it can."""
    n = lambda c: F.size(F.col(c))
    tokens = n("prompt_ids") + n("completion_ids")
    rules = [
        ("prompt mask length", n("prompt_mask") != n("prompt_ids")),
        ("completion mask length", n("completion_mask") != n("completion_ids")),
        ("completion logprobs length", n("completion_logprobs") != n("completion_ids")),
        ("completion temperatures length", n("completion_temperatures") != n("completion_ids")),
        ("empty sample", tokens == 0),
        ("sample too long", tokens > seq_len),
        ("teacher logprobs length", F.col("teacher_logprobs").isNotNull() & (n("teacher_logprobs") != tokens)),
    ]
    out = F.lit(None).cast("string")
    for reason, broken in reversed(rules):
        out = F.when(broken, reason).otherwise(out)
    return out


def drop_errored(df: DataFrame, group: str = "group_id", error: str = "error", whole_groups: Column | None = None) -> DataFrame:
    """Rows without error; where ``whole_groups`` holds, one error drops the group."""
    alone = F.col(error).isNull()
    if whole_groups is None:
        return df.where(alone)
    bad = F.max(F.col(error).isNotNull()).over(W.partitionBy(group))
    return df.withColumn("_bad", bad).where(F.when(whole_groups, ~F.col("_bad")).otherwise(alone)).drop("_bad")


def promote_empty(df: DataFrame, trajectory: str = "trajectory", error: str = "error") -> DataFrame:
    """An empty trajectory without error becomes the error EmptyTrajectory."""
    empty = F.col(error).isNull() & (F.coalesce(F.size(trajectory), F.lit(0)) <= 0)
    return df.withColumn(error, F.when(empty, F.lit("EmptyTrajectory")).otherwise(F.col(error)))


def has_trainable(mask, seq_len: int) -> Column:
    return F.exists(F.slice(_c(mask), 1, seq_len), lambda x: x)


def metric_key_allowed(key, keep_prefixes: list[str] = (), drop_prefixes: list[str] = (), drop_suffixes: list[str] = (), depth: int | None = None) -> Column:
    """Prefixes, suffixes and the number of path parts decide over a metric key."""
    k = _c(key)
    out = F.lit(True)
    for p in drop_prefixes:
        out = out & ~k.startswith(p)
    for x in drop_suffixes:
        out = out & ~k.endswith(x)
    if depth is not None:
        out = out & (F.size(F.split(k, "/")) <= depth)
    for p in keep_prefixes:
        out = out | k.startswith(p)
    return out


def exact_sample(df: DataFrame, ratio: float | None, key: str, seed: int = 0) -> DataFrame:
    """max(1, floor(n * ratio)) rows by the hash of their key; all for null or 1 and more, none for 0 and less.

    The bound on the hash comes from histograms, so that no task sees the sample and nothing is sorted; rows of the one
    key at the bound, which differ in nothing that counts, are taken as they come."""
    if ratio is None or ratio >= 1:
        return df
    if ratio <= 0:
        return df.limit(0)
    n = df.count()
    return smallest(df, hash_number(F.col(key), seed=seed), max(1, int(n * ratio)) if n else 0, HASH_BITS, key)


def kept_steps(df: DataFrame, step: str = "step", last: int | None = None, interval: int | None = None, partition: str | None = None) -> DataFrame:
    """The last ``last`` steps and those on the interval; all if neither is set."""
    if last is None and interval is None:
        return df
    keep = F.lit(False)
    if interval:
        keep = keep | (F.col(step) % interval == 0)
    if last is not None and partition is None:
        top = [r[0] for r in df.select(step).distinct().orderBy(F.desc(step)).limit(last).collect()]
        keep = keep | F.col(step).isin(top)
        return df.where(keep)
    if last is not None:
        return df.withColumn("_rank", F.dense_rank().over(W.partitionBy(partition).orderBy(F.desc(step)))).where(keep | (F.col("_rank") <= last)).drop("_rank")
    return df.where(keep)


def broadcast_to_remove(step: Column, interval: int | None) -> Column:
    """The broadcast that a new step makes obsolete: two steps back, unless on the interval; null if none."""
    candidate = F.greatest(step - 2, F.lit(0))
    return F.when(F.lit(interval is None) | (candidate % F.lit(interval or 1) != 0), candidate)


def future_steps(df: DataFrame, resume_step: int, step: str = "step") -> DataFrame:
    return df.where(F.col(step) > resume_step)


def drop_stale(df: DataFrame, version_now: int, max_off_policy: int = 8, group: str = "group_id", version: str = "policy_version", kind: str | None = None) -> DataFrame:
    """Groups whose oldest train row is more than ``max_off_policy`` versions behind go; eval rows never age."""
    age = F.lit(version_now) - F.col(version)
    if kind:
        age = F.when(F.col(kind) == "train", age).otherwise(0)
    return df.withColumn("_age", F.max(age).over(W.partitionBy(group))).where(F.col("_age") <= max_off_policy).drop("_age")


def io_row(df: DataFrame, raw: str, drop: list[str] = ("samples",), rename: dict[str, str] | None = None) -> DataFrame:
    """The raw struct's fields with the other columns over them."""
    rename = rename or {"filter_results": "filters"}
    typed = [c for c in df.columns if c not in (raw, *drop)]
    names = {c: rename.get(c, c) for c in typed}
    fields = [f.name for f in df.schema[raw].dataType.fields if f.name not in names.values()]
    return df.select(*[F.col(f"{raw}.{f}").alias(f) for f in fields], *[F.col(c).alias(n) for c, n in names.items()])


def finite_json(df: DataFrame, column: str, out: str = "finite", dropped: str = "dropped") -> DataFrame:
    """JSON text without the numbers that aren't finite, at any depth, and the paths of those: ``a.b[2]``, places as
    in the text before. Null and unreadable text stay as they are, with no paths."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(dropped, T.ArrayType(T.StringType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [_finite(x) for x in frame[column]]
            yield frame.assign(**{out: [p[0] for p in pairs], dropped: [p[1] for p in pairs]})

    return df.mapInPandas(run, schema)


def _finite(text: str | None) -> tuple[str | None, list[str]]:
    if text is None:
        return None, []
    try:
        root = [json.loads(text)]
    except ValueError:
        return text, []
    paths: list[str] = []
    # containers still to be gone through, each with its path; the root's own path is empty
    todo: list[tuple[dict | list, str | None]] = [(root, None)]
    while todo:
        held, path = todo.pop()
        children = list(held.items()) if isinstance(held, dict) else list(enumerate(held))
        gone = []
        for key, value in children:
            if path is None:
                at = ""
            elif isinstance(held, dict):
                at = f"{path}.{key}" if path else str(key)
            else:
                at = f"{path}[{key}]"
            if isinstance(value, float) and not math.isfinite(value):
                gone.append(key)
                paths.append(at)
            elif isinstance(value, dict | list):
                todo.append((value, at))
        for key in reversed(gone):
            del held[key]
    return (json.dumps(root[0]) if root else None), sorted(paths)
