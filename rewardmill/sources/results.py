"""Evaluation result records as JSON lines, laid out by task and seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.operators.evaluation import model_folder, run_key
from rewardmill.sources.folders import replace_folders

# Fields of a result record.
RECORD_SCHEMA = """
    start_time timestamp, end_time timestamp, total_evaluation_time_seconds double,
    model string, temperature double, top_p double, top_k int, repetition_penalty double,
    task string, max_new_tokens int, max_model_length int, gpu_memory_utilization double,
    dtype string, seed int, system_prompt string, use_chat_template boolean,
    results map<string,double>, slurm_job_id string, version string, launcher_type string,
    device_name string, lighteval_config string
"""

_DEFAULTS = {
    "top_k": ("int", None),
    "repetition_penalty": ("double", None),
    "gpu_memory_utilization": ("double", None),
    "dtype": ("string", "bfloat16"),
    "system_prompt": ("string", None),
    "use_chat_template": ("boolean", True),
    "slurm_job_id": ("string", None),
    "version": ("string", None),
    "launcher_type": ("string", "VLLM"),
    "device_name": ("string", None),
    "lighteval_config": ("string", None),
}


def _fields() -> list[str]:
    return [part.split()[0] for part in RECORD_SCHEMA.replace("\n", " ").split(", ")]


def result_records(runs: DataFrame, metric: str = "extractive_match") -> DataFrame:
    """Full records from runs with ``accuracy``, start, end and sampling settings."""
    filled = runs
    for name, (kind, value) in _DEFAULTS.items():
        if name not in runs.columns:
            filled = filled.withColumn(name, F.lit(value).cast(kind))
    seconds = (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6)
    filled = filled.withColumn("total_evaluation_time_seconds", seconds).withColumn(
        "results", F.create_map(F.lit(metric), F.col("accuracy"))
    )
    return filled.select(*_fields())


def write_results(records: DataFrame, path: str) -> None:
    """Append records under ``task=.../seed=...``.

    Rows are rebalanced by run before writing, so that a folder gets a few files
    instead of one per task of the job.
    """
    placed = records.hint("rebalance", "task", "seed")
    placed.write.mode("append").partitionBy("task", "seed").option("ignoreNullFields", "false").json(path)


def replace_results(records: DataFrame, path: str) -> None:
    """Write records under ``folder=.../run_key=...``, in place of earlier records of the same run.

    A run is a model with seed, sampling settings, task, length limits and template, as ``run_key`` names it.
    Only the folders of runs in ``records`` are replaced, when the job commits: a repeated or restarted job leaves
    the same table. Of several records of one run the one that ended last stays.
    """
    # The digest orders records that ended together.
    latest = F.struct("end_time", "start_time", F.md5(F.to_json(F.struct(*_fields())).cast("binary")))
    key = run_key(*[F.col(c) for c in ("seed", "temperature", "top_p", "task", "max_new_tokens", "max_model_length", "use_chat_template")])
    runs = records.select(*_fields(), model_folder(F.col("model")).alias("folder"), key.alias("run_key"))
    one = runs.groupBy("folder", "run_key").agg(F.max_by(F.struct(*_fields()), latest).alias("record")).select("folder", "run_key", "record.*")
    replace_folders(one, path, ["folder", "run_key"], "json", ignoreNullFields="false")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is not blank, with its file, its parsed record, and whether it cannot be used as one."""
    lines = spark.read.text(path)
    placed = [c for c in lines.columns if c != "value"]
    parsed = F.from_json("value", f"{RECORD_SCHEMA}, __damaged string", {"columnNameOfCorruptRecord": "__damaged"})
    read = lines.filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), *placed, parsed.alias("r"))
    kinds = {f.name: f.dataType for f in read.schema["r"].dataType.fields}
    # Fields by which folders are named are not in the lines.
    record = [(F.col(f) if f in placed else F.col("r")[f]).cast(kinds[f]).alias(f) for f in _fields()]
    whole = read.select("value", "file", F.col("r")["__damaged"].alias("__damaged"), *record)
    lacking = F.col("model").isNull() | F.col("task").isNull() | F.col("results").isNull()
    return whole.withColumn("damaged", F.col("__damaged").isNotNull() | lacking).drop("__damaged")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Read records back, of either layout; filters on what names the folders prune them.

    Lines that are no record (cut off, of wrong types, without model, task or results) are left to ``damaged_results``.
    """
    return _lines(spark, path).filter(~F.col("damaged")).select(*_fields())


def damaged_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of every line that ``read_results`` leaves out; blank lines are in neither."""
    return _lines(spark, path).filter("damaged").select("file", F.col("value").alias("line"))
