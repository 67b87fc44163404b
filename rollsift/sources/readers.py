"""Readers: rollouts, token exports, scrapes, benchmark records, step folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIGNED = [
    "token_ids", "position_ids", "advantages", "rewards", "inference_logprobs", "trainer_logprobs", "entropy", "mismatch_kl",
    "log_importance_ratio", "importance_ratio", "prob_delta", "is_masked", "is_masked_high", "is_masked_low",
]
TOKEN_EXPORT = (
    "schema_version int, step int, export_step int, rank int, micro_step int, micro_sequence_idx int, export_sequence_idx int, run_id string, env_name string, "
    "training_mode string, token_ids array<bigint>, position_ids array<bigint>, loss_mask array<boolean>, advantages array<double>, rewards array<double>, "
    "inference_logprobs array<double>, trainer_logprobs array<double>, entropy array<double>, mismatch_kl array<double>, log_importance_ratio array<double>, "
    "importance_ratio array<double>, prob_delta array<double>, is_masked array<boolean>, is_masked_high array<boolean>, is_masked_low array<boolean>"
)
BENCHMARK = (
    "config struct<type:string,num_gpus:int,model_name:string,lora_rank:int,seq_len:int,ac:string,attention:string,ep:int,cp:int,device_name:string,success:boolean>, "
    "metrics struct<mfu:struct<mean:double,std:double,min:double,max:double>,throughput:struct<mean:double,std:double,min:double,max:double>,"
    "step_time:struct<mean:double,std:double,min:double,max:double>,peak_memory:struct<gib:double,pct:double>>"
)
LOG_ENTRY = "timestamp string, level string, logger string, message string, step bigint, total bigint, progress double"

# Exposition names of the scraped metrics, by kind.
COUNTERS = {
    "vllm:prompt_tokens": "prompt_tokens_total", "vllm:prompt_tokens_total": "prompt_tokens_total", "vllm:generation_tokens": "generation_tokens_total",
    "vllm:generation_tokens_total": "generation_tokens_total", "vllm:request_success": "request_success_total", "vllm:request_success_total": "request_success_total",
    "vllm:prefix_cache_queries": "prefix_cache_queries", "vllm:prefix_cache_queries_total": "prefix_cache_queries", "vllm:prefix_cache_hits": "prefix_cache_hits",
    "vllm:prefix_cache_hits_total": "prefix_cache_hits",
}
GAUGES = {
    "vllm:num_requests_running": "running_requests", "vllm:num_requests_waiting": "waiting_requests", "vllm:kv_cache_usage_perc": "kv_cache_usage_perc",
    "vllm:gpu_cache_usage_perc": "kv_cache_usage_perc", "vllm:cpu_cache_usage_perc": "cpu_cache_usage_perc", "vllm:gpu_prefix_cache_hit_rate": "gpu_prefix_cache_hit_rate",
    "vllm:cpu_prefix_cache_hit_rate": "cpu_prefix_cache_hit_rate",
}
HISTOGRAMS = ["request_prefill_time_seconds", "request_decode_time_seconds", "request_queue_time_seconds", "time_to_first_token_seconds", "inter_token_latency_seconds", "e2e_request_latency_seconds"]


def tabular(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """Parquet or JSON lines; JSON with a schema isn't scanned twice."""
    if kind == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def rollouts(spark: SparkSession, path: str, schema: str, partition: tuple[str, ...] = ("step",)) -> DataFrame:
    """What ``writers.rollouts`` wrote: JSON lines, and the partition's values from the names of their folders.

    Folders are only listed: Spark's discovery of partitions takes time by the square of their number, on the driver."""
    fields = T.StructType.fromDDL(schema).fields
    lines = spark.read.schema(T.StructType([f for f in fields if f.name not in partition])).option("recursiveFileLookup", "true").json(path)
    decoded = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    named = lambda c: decoded(decoded(F.regexp_extract("_metadata.file_path", rf"^.*/\Q{c}\E=([^/]*)/", 1)))  # noqa: E731  # as the path has it, and as the folder has it
    value = lambda f: F.nullif(named(f.name), F.lit("__HIVE_DEFAULT_PARTITION__")).cast(f.dataType).alias(f.name)
    return lines.select(*[value(f) if f.name in partition else F.col(f.name) for f in fields])


def stable_folders(spark: SparkSession, path: str) -> list[str]:
    """The step folders with a STABLE marker, under the path or one level deeper (a run's).

    Listed by the file system: markers are empty files, which file sources skip."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for pattern in (f"{path}/step_*/STABLE", f"{path}/*/step_*/STABLE"):
        found += [s.getPath().getParent().toString() for s in fs.globStatus(hadoop(pattern)) or []]
    return sorted(set(found))


def token_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good records, counts of bad ones by file) of step folders that have a STABLE marker.

    A record is bad if it is no JSON or an aligned field's length differs from its mask's; blank lines don't count."""
    folders = stable_folders(spark, path)
    if folders:  # only those are listed and read
        raw = spark.read.option("pathGlobFilter", "rank_*.jsonl").text(folders).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    else:
        raw = spark.createDataFrame([], "value string, file string")
    parsed = raw.withColumn("_r", F.from_json("value", TOKEN_EXPORT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    even = F.lit(True)
    for c in ALIGNED:
        even = even & (F.col(f"_r.{c}").isNull() | (F.size(f"_r.{c}") == F.size("_r.loss_mask")))
    good = F.col("_r._corrupt").isNull() & F.col("_r.loss_mask").isNotNull() & even
    return parsed.where(good).select("_r.*").drop("_corrupt"), parsed.where(~good).groupBy("file").agg(F.count("*").alias("bad"))


def scraped(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("endpoint", "role", "ts")) -> DataFrame:
    """Exposition text to (keys, engine, metric, value): counters of one engine add up over labels, of others the last line counts.

    A sample without engine label belongs to "aggregate"."""
    names = {**COUNTERS, **GAUGES} | {f"vllm:{h}_{s}": f"{h}_{s}" for h in HISTOGRAMS for s in ("sum", "count")}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    counters = [*COUNTERS]
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("_at", "_line")).where(~F.col("_line").startswith("#") & (F.trim("_line") != ""))
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{.*\})?\s+(\S+)"
    parts = lines.select(
        *keys, "_at", F.regexp_extract("_line", pattern, 1).alias("_name"), F.regexp_extract(F.regexp_extract("_line", pattern, 2), r'engine="([^"]*)"', 1).alias("_engine"),
        F.expr(f"try_cast(regexp_extract(_line, r'{pattern}', 3) as double)").alias("value"),
    )
    named = parts.withColumn("metric", F.try_element_at(known, F.col("_name"))).where(F.col("metric").isNotNull())
    engine = F.when(F.col("_engine") == "", F.lit("aggregate")).otherwise(F.col("_engine"))
    value = F.when(F.bool_or(F.col("_name").isin(counters)), F.sum("value")).otherwise(F.max_by("value", "_at"))
    return named.groupBy(*keys, engine.alias("engine"), "metric").agg(value.alias("value"))


def benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark records of a folder tree; files that are no record are left out."""
    return spark.read.schema(BENCHMARK).option("multiLine", "true").option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(path).where(F.col("config").isNotNull()).withColumn("file", F.input_file_name())


def step_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """(step, stable): steps found in paths of files, and whether one is the STABLE marker."""
    step = F.regexp_extract(path, r"/step_(\d+)(?:/|$)", 1)
    found = paths.where(step != "").select(step.cast("long").alias("step"), F.col(path).endswith("/STABLE").alias("_stable"))
    return found.groupBy("step").agg(F.bool_or("_stable").alias("stable"))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def pending_batches(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run's next batch, if it has come and the run isn't waiting for an update.

    batches: (run_id, step, ...); runs: (run_id, next_step, ready_to_update)."""
    waiting = runs.where(~F.col("ready_to_update")).select("run_id", F.col("next_step").alias("step"))
    return batches.join(waiting, ["run_id", "step"])


def oldest_pending(messages: DataFrame, sender: str = "sender", step: str = "step") -> DataFrame:
    """Buffered messages of each sender's oldest step."""
    oldest = messages.groupBy(sender).agg(F.min(step).alias(step))
    return messages.join(oldest, [sender, step], "left_semi")


def for_rank(micro_batches: DataFrame, rank: int, column: str = "worker") -> DataFrame:
    return micro_batches.where(F.col(column) == rank)


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_ENTRY).json(path)
