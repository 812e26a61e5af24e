"""Read training sets and benchmarks by their short names."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rewardmill.registry import SFT_SOURCES, TASKS, Task, training_dataset

FORMATS = ("parquet", "json", "csv", "orc")


@dataclass(frozen=True)
class Location:
    """Where a source lives and how it is read. ``schema`` avoids a pass for inference."""

    path: str
    format: str = "parquet"
    schema: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)


Locate = Callable[[str, str | None, str], Location]


def below(root: str, format: str = "parquet") -> Locate:
    """Locate sources at ``root/source id[/config]/split``."""
    def locate(source: str, config: str | None, split: str) -> Location:
        parts = [root.rstrip("/"), source, *([config] if config else []), split]
        return Location("/".join(parts), format)

    return locate


def read_location(spark: SparkSession, location: Location) -> DataFrame:
    if location.format not in FORMATS:
        raise ValueError(f"unknown format {location.format!r}; known: {FORMATS}")
    reader = spark.read.format(location.format).options(**location.options)
    if location.schema:
        reader = reader.schema(location.schema)
    return reader.load(location.path)


def read_training_set(
    spark: SparkSession, name: str, locate: Locate, config: str | None = None, split: str = "train"
) -> DataFrame:
    return read_location(spark, locate(training_dataset(name).source, config, split))


def read_sft_set(
    spark: SparkSession, name: str, locate: Locate, config: str | None = None, split: str = "train"
) -> DataFrame:
    if name not in SFT_SOURCES:
        raise KeyError(f"unknown SFT dataset {name!r}; known: {sorted(SFT_SOURCES)}")
    return read_location(spark, locate(SFT_SOURCES[name], config, split))


def read_benchmark(spark: SparkSession, task: Task | str, locate: Locate) -> DataFrame:
    task = TASKS[task] if isinstance(task, str) else task
    config = None if task.subset == "default" else task.subset
    return read_location(spark, locate(task.source, config, task.split))
