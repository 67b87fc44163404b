"""Many small partition folders in a shared folder (``file:``): lines that tasks write, and that the driver only renames.

Hadoop's local file system starts a process (chmod) for each folder, file and checksum, some 20 ms a step. Here a task
writes one file a partition into a folder of its own, and only the folders of tasks that Spark has taken are published.
Names are those that Spark's writers give.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: A partition's values as a JSON array of strings, and a line.
COLUMNS = "key string, value string"
_ESCAPED = re.compile(r"[\x01-\x1F\"#%'*/:=?\\\x7F{\[\]^]")


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that a path names in a file system that every machine mounts; None in a store of another kind."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def partition_folder(columns: list[str], values: list[str | None]) -> str:
    escaped = lambda x: _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", x)
    return "/".join(f"{escaped(c)}={escaped(v) if v else '__HIVE_DEFAULT_PARTITION__'}" for c, v in zip(columns, values, strict=True))


@dataclass
class TaskFolder(WriterCommitMessage):
    name: str


class StepWriter(DataSourceArrowWriter):
    """A task's partitions are folders in a folder of its attempt, where ``folders`` names them, one a line."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.attempt = path, columns, uuid.uuid4().hex

    @property
    def staged(self) -> str:
        return f"{self.path}/_attempts/{self.attempt}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFolder:
        name = uuid.uuid4().hex  # of this attempt at the task
        root, held, out = f"{self.staged}/{name}", None, None
        os.makedirs(root)
        with open(f"{root}/folders", "w") as folders:
            try:
                for b in iterator:
                    runs, begin = pc.run_end_encode(b.column(0)), 0
                    for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                        if key != held:
                            if out:
                                out.close()
                            folder = partition_folder(self.columns, json.loads(key))
                            os.makedirs(f"{root}/{folder}")
                            out, held = open(f"{root}/{folder}/part-{name}.json", "w", encoding="utf-8", newline=""), key
                            folders.write(json.dumps(folder) + "\n")
                        out.write("\n".join(b.column(1).slice(begin, end - begin).to_pylist()) + "\n")
                        begin = end
            finally:
                if out:
                    out.close()
        return TaskFolder(name)

    def commit(self, messages: list[TaskFolder | None]) -> None:
        """A rename a partition; one that several tasks wrote gets the others' files."""
        placed = set()
        for root in (f"{self.staged}/{m.name}" for m in messages if m):
            with open(f"{root}/folders") as folders:
                for folder in map(json.loads, folders):
                    source, target = f"{root}/{folder}", f"{self.path}/{folder}"
                    if folder in placed:
                        for file in os.listdir(source):
                            os.rename(f"{source}/{file}", f"{target}/{file}")
                        continue
                    if len(self.columns) > 1:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                    if os.path.isdir(target):
                        shutil.rmtree(target)
                    os.rename(source, target)
                    placed.add(folder)
        self._gone()

    def abort(self, messages: list[TaskFolder | None]) -> None:
        self._gone()

    def _gone(self) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)
        with suppress(OSError):  # another writer's attempt is there
            os.rmdir(f"{self.path}/_attempts")


class StepFiles(DataSource):
    """``df.write.format("step_files")`` of (key, value). Options: path, and columns (a JSON array of names)."""

    @classmethod
    def name(cls) -> str:
        return "step_files"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: StructType, overwrite: bool) -> StepWriter:
        return StepWriter(self.options["path"], json.loads(self.options["columns"]))


def json_folders(df: DataFrame, folder: str, by: list[str]) -> None:
    """JSON lines by partition, as ``df.write.partitionBy(*by).json``; partitions that come replace what they held."""
    df.sparkSession.dataSource.register(StepFiles)
    os.makedirs(folder, exist_ok=True)
    key = F.to_json(F.array(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in by]))  # neither has a name of its own
    lines = df.select(key.alias("key"), F.to_json(F.struct(*[c for c in df.columns if c not in by])).alias("value"))
    lines.sortWithinPartitions("key").write.format("step_files").mode("append").options(path=folder, columns=json.dumps(by)).save()
