"""Step folders of several runs as a stream: each run's steps in order, whole ones only, each once.

The layout is that of a published export, a run deeper: ``run_X/step_N/rank_R.jsonl`` and STABLE when the step is whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LINES = "run_id string, step long, line string"


def _filesystem(uri: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _names(fs, folder: str) -> list[str]:
    import pyarrow.fs

    return [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))]


@dataclass
class StepRange(InputPartition):
    """Steps of a run, the last one left out: one task."""

    run: str
    first: int
    last: int


#: Tasks of a micro-batch, beside one more a run; with fewer steps each is a task.
TASKS = 200


class StepReader(DataSourceStreamReader):
    """Offsets name each run's next step. A run goes on as far as its steps are whole, so that a step that comes early
    waits for those before it; steps that are already given may be deleted."""

    def __init__(self, path: str, first: int):
        self.path, self.first = path, first
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = _filesystem(self.path)
        for run in sorted(n for n in _names(fs, root) if n.startswith("run_")):
            steps = {int(m[1]) for n in _names(fs, f"{root}/{run}") if (m := re.fullmatch(r"step_(\d+)", n))}
            at = self.known.get(run, self.first)
            while at in steps and fs.get_file_info(f"{root}/{run}/step_{at}/STABLE").is_file:
                at += 1
            self.known[run] = at
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[StepRange]:
        for run, at in start.items():
            self.known[run] = max(self.known.get(run, at), at)
        spans = [(run, start.get(run, self.first), end[run]) for run in sorted(end)]
        width = max(1, -(-sum(last - first for _, first, last in spans) // TASKS))
        return [StepRange(run, at, min(at + width, last)) for run, first, last in spans for at in range(first, last, width)]

    def read(self, partition: StepRange) -> Iterator[tuple]:
        fs, root = _filesystem(self.path)
        for step in range(partition.first, partition.last):
            yield from self._lines(fs, f"{root}/{partition.run}/step_{step}", partition.run, step)

    def _lines(self, fs, folder: str, run: str, step: int) -> Iterator[tuple]:
        for name in sorted(n for n in _names(fs, folder) if re.fullmatch(r"rank_\d+\.jsonl", n)):
            with fs.open_input_stream(f"{folder}/{name}") as f:
                rest = b""
                while block := f.read(1 << 20):
                    *lines, rest = (rest + block).split(b"\n")
                    for line in lines:
                        if line.strip():
                            yield run, step, line.decode()
                if rest.strip():
                    yield run, step, rest.decode()

    def commit(self, end: dict) -> None:
        pass


class RunSteps(DataSource):
    """``spark.readStream.format("run_steps")``: a row a line. Options: path, and first (the first step's number, 0)."""

    @classmethod
    def name(cls) -> str:
        return "run_steps"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: StructType) -> StepReader:
        return StepReader(self.options["path"], int(self.options.get("first", "0")))


def transported(spark: SparkSession, path: str, schema: str, first: int = 0) -> DataFrame:
    """Stream: run_id, step and the fields of ``schema`` of each line; a line that is no JSON gives nulls."""
    spark.dataSource.register(RunSteps)
    lines = spark.readStream.format("run_steps").option("path", path).option("first", str(first)).load()
    return lines.withColumn("_r", F.from_json("line", schema)).select(F.col("run_id"), F.col("step"), "_r.*")
