"""Steps of a rollout merged into training samples.

A step whose prompt starts with all tokens of an open sample continues the
longest such sample; otherwise it opens one. Samples of a rollout depend on its
steps' order only, so rollouts are independent rows of work: a rollout is one
array, merged inside one Arrow batch, and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = "sample_idx int, prompt_ids array<bigint>, prompt_mask array<boolean>, completion_ids array<bigint>, completion_mask array<boolean>, completion_logprobs array<double>"


@dataclass
class OpenSample:
    prompt: list[int]
    prompt_mask: list[bool]
    ids: list[int] = field(default_factory=list)
    mask: list[bool] = field(default_factory=list)
    logprobs: list[float] = field(default_factory=list)

    def extends(self, prompt: list[int]) -> int:
        """Length of the sample if the prompt starts with it, else -1."""
        n, p = len(self.prompt) + len(self.ids), len(self.prompt)
        return n if n <= len(prompt) and prompt[:p] == self.prompt and prompt[p:n] == self.ids else -1

    def add(self, ids: list[int], mask: list[bool], logprobs: list[float]) -> None:
        self.ids += ids
        self.mask += mask
        self.logprobs += logprobs


def merge_steps(steps: list[dict], errored: bool) -> list[OpenSample] | None:
    """Samples in the order they were opened; None for no steps or a step without tokens.

    Of equally long samples the first one opened continues. An error masks every completion."""
    if not steps or any(s["prompt_ids"] is None or s["completion_ids"] is None for s in steps):
        return None
    out: list[OpenSample] = []
    for s in steps:
        prompt, done = list(s["prompt_ids"]), list(s["completion_ids"])
        lengths = [x.extends(prompt) for x in out]
        best = max(lengths, default=-1)
        if best < 0:
            target = OpenSample(prompt, list(s["prompt_mask"]))
            out.append(target)
        else:
            target = out[lengths.index(best)]
            new = prompt[best:]
            target.add(new, [False] * len(new), [0.0] * len(new))
        target.add(done, [False] * len(done) if errored else list(s["completion_mask"]), list(s["completion_logprobs"]))
    return out


def interleaved(df: DataFrame, keep: tuple[str, ...] = ("rollout_id",), steps: str = "steps", error: str = "error") -> DataFrame:
    """A row for each sample. steps: array of structs with prompt_ids, prompt_mask, completion_ids, completion_mask, completion_logprobs."""
    picked = df.select(*keep, steps, F.col(error).isNotNull().alias("_errored"))
    schema = T.StructType([*picked.schema.fields[: len(keep)], *T._parse_datatype_string(SAMPLE).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False, name=None):
                held = row[len(keep)]
                samples = merge_steps([] if held is None else [s if isinstance(s, dict) else s.asDict() for s in held], row[-1]) or []
                rows += [(*row[: len(keep)], i, s.prompt, s.prompt_mask, s.ids, s.mask, s.logprobs) for i, s in enumerate(samples)]
            yield pd.DataFrame(rows, columns=schema.names)

    return picked.mapInPandas(run, schema)


def stitched_routes(steps: list[dict]) -> list[list | None]:
    """The expert rows of each step's whole sequence (prompt and completion), from payloads that begin where an earlier
    step's sequence had none left.

    A payload that starts at s > 0 needs an earlier sequence of s + 1 tokens, all at the start of the prompt; of several
    the first counts, and its rows before s come first. The row at s is the payload's own: a sequence's last token had
    none yet. Rows beyond the sequence go, missing ones are zero. None for a step without payload."""
    known: dict[tuple, list] = {}
    out: list[list | None] = []
    for s in steps:
        routed, start = s["routed"], s["routed_start"]
        if routed is None:
            out.append(None)
            continue
        whole = (*s["prompt_ids"], *s["completion_ids"])
        rows = [list(r) for r in routed]
        if start:
            before = known.get(tuple(s["prompt_ids"][: start + 1])) if len(s["prompt_ids"]) > start else None
            if before is None or len(before) < start:
                raise ValueError(f"no earlier sequence gives the {start} rows before a payload")
            rows = before[:start] + rows
        known.setdefault(whole, rows)
        width = len(rows[0]) if rows else 0
        out.append((rows + [[0] * width] * (len(whole) - len(rows)))[: len(whole)])
    return out


def routed(df: DataFrame, keep: tuple[str, ...] = ("rollout_id",), steps: str = "steps") -> DataFrame:
    """keep, step (from 0) and the rows of its whole sequence. steps: structs with prompt_ids, completion_ids, routed
    (array of arrays of experts, or null) and routed_start."""
    picked = df.select(*keep, steps)
    schema = T.StructType([*picked.schema.fields[: len(keep)], *T._parse_datatype_string("step int, routed array<array<int>>").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False, name=None):
                held = [] if row[-1] is None else [s if isinstance(s, dict) else s.asDict() for s in row[-1]]
                rows += [(*row[:-1], k, r) for k, r in enumerate(stitched_routes(held))]
            yield pd.DataFrame(rows, columns=schema.names)

    return picked.mapInPandas(run, schema)
