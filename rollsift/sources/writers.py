"""Writers: rollouts, token exports, sample tables, metric history, reports."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollsift.functions.arrays import trim_trailing
from rollsift.functions.scalars import finite_or_null, json_text
from rollsift.sources.step_files import json_folders, shared_folder


def rollouts(df: DataFrame, path: str, exclude: tuple[str, ...] = ("trajectory",), partition: tuple[str, ...] = ("step",)) -> None:
    """JSON lines by step; a step that is written again replaces only itself. Without such a column all is replaced.

    Folders and names are those of Spark's writer, which takes stores of other kinds than a shared folder."""
    by, rows = [p for p in partition if p in df.columns], df.drop(*exclude)
    folder = shared_folder(df.sparkSession, path)
    if folder and by and set(by) < set(rows.columns):
        json_folders(rows, folder, by)
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def exportable(df: DataFrame, mask: str = "loss_mask", env: str = "env_names", arrays: tuple[str, ...] = ()) -> DataFrame:
    """Sequences with a trained token, without trailing padding; non-finite numbers become null."""
    n = trim_trailing(F.arrays_zip(F.col(mask).alias("m"), F.col(env).alias("e")), lambda x, _: ~x["m"] & (x["e"] == ""))
    rows = df.where(F.exists(mask, lambda x: x)).withColumn("_n", n)
    for c in (mask, env, *arrays):
        kind = df.schema[c].dataType
        cut = F.slice(c, F.lit(1), F.col("_n"))
        rows = rows.withColumn(c, F.transform(cut, finite_or_null) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType) else cut)
    return rows.drop("_n")


#: Small files cost their number, not their bytes: an export names its number of tasks, so that it isn't cut by bytes, and
#: tasks commit their own files, to a folder that nobody reads before the write is done.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: Steps of an export that the driver publishes at a time.
PUBLISHERS = 16


def staged_export(df: DataFrame, path: str, order: tuple[str, ...] = ("micro_step", "micro_sequence_idx")) -> str:
    """First phase of an export: JSON lines, a file for each step and rank, in a folder of this attempt. Returns it.

    A step's rank is one file and so one task; its rows are sorted by ``order`` where those columns are there. Null
    fields are kept. Nothing that readers see has changed yet, whatever becomes of the attempt."""
    attempt = f"{path.rstrip('/')}/_attempts/{uuid.uuid4().hex}"
    by = ["export_step", "rank"]
    rows = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, *[c for c in order if c in df.columns])
    lines = rows.select(*by, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.options(**BY_TASKS).partitionBy(*by).text(attempt)
    return attempt


def commit_export(spark: SparkSession, attempt: str, path: str) -> list[int]:
    """Second phase: files move to ``step_N/rank_R.jsonl``, then a step's STABLE marker is made. Returns the steps published.
    Steps are independent of each other, and several are published at a time.

    A step with a marker isn't touched, so that a second attempt adds nothing; a commit that was broken off can be done
    again, with the same attempt or another. One process commits a path at a time."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def publish(n: str) -> int | None:
        folder, marker = hadoop(root, f"step_{n}"), hadoop(root, f"step_{n}/STABLE")
        if fs.exists(marker):
            return None
        fs.mkdirs(folder)
        for file in fs.globStatus(hadoop(f"{attempt}/export_step={n}/rank=*/part-*")) or []:
            target = hadoop(folder, f"rank_{file.getPath().getParent().getName().partition('=')[2]}.jsonl")
            fs.delete(target, False)
            if not fs.rename(file.getPath(), target):
                raise OSError(f"{target} can't be published")
        fs.create(marker, True).close()
        return int(n)

    steps = [s.getPath().getName().partition("=")[2] for s in fs.globStatus(hadoop(f"{attempt}/export_step=*")) or []]
    with ThreadPoolExecutor(PUBLISHERS) as pool:
        done = [n for n in pool.map(publish, steps) if n is not None]
    fs.delete(hadoop(attempt), True)
    return sorted(done)


def token_export(df: DataFrame, path: str) -> list[int]:
    """Both phases: an export that ``readers.token_export`` reads. Returns the steps that are new."""
    return commit_export(df.sparkSession, staged_export(df, path), path)


def sample_rows(df: DataFrame, run_id: str, step: int, tag: str) -> DataFrame:
    """Rows of the sample table. df has sample_id (place in the batch), example_id, prompt, completion, trajectory and the measured columns.

    Rows without prompt, completion or trajectory are left out, and keep their places."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = lambda c: json_text(c, kinds[c]).alias(c) if c in kinds else F.lit("").alias(c)
    whole = df.where(F.col("prompt").isNotNull() & F.col("completion").isNotNull() & F.col("trajectory").isNotNull())
    return whole.select(
        F.lit(run_id).alias("run_id"), F.lit(step).cast("bigint").alias("step"), F.lit(tag).alias("tag"),
        F.coalesce(F.expr("try_cast(example_id as bigint)"), F.col("sample_id").cast("bigint")).alias("problem_id"), F.col("sample_id").cast("bigint").alias("sample_id"),
        text("prompt"), text("completion"), text("trajectory"), text("answer"), F.col("env_name"), text("task"), text("info"), F.col("reward").cast("double").alias("reward"),
        F.col("advantage").cast("double").alias("advantage"), text("metrics"), text("timing"), F.col("num_input_tokens").cast("bigint").alias("num_input_tokens"),
        F.col("num_output_tokens").cast("bigint").alias("num_output_tokens"), F.current_timestamp().alias("created_at"),
    )


def samples(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("compression", "snappy").partitionBy("tag", "step").parquet(path)


def metric_history(df: DataFrame, path: str, last_only: bool = False) -> None:
    """Long rows (step, key, value); only the last step's where asked."""
    if last_only:
        top = df.agg(F.max("step").alias("_s"))
        df = df.join(F.broadcast(top), F.col("step") == F.col("_s"), "left_semi")  # one row
    df.write.mode("append").parquet(path)


def logged_sample(df: DataFrame, trajectory: str = "trajectory") -> DataFrame:
    """The last step of each trajectory, as shown in sample tables."""
    return df.where(F.size(trajectory) > 0).withColumn("last_step", F.element_at(trajectory, -1)).drop(trajectory)


def markdown(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """One table of markdown text for each group, rows in the order of the columns."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*columns, cells.alias("_line")))), lambda r: r["_line"]), "\n")
    return df.groupBy(group).agg(F.concat(F.lit(head), body).alias("table"))


def progress(df: DataFrame, path: str) -> None:
    """Counters of a run: one row, replaced at each call."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
