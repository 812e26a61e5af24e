"""Session construction and the two ways to cut a plan: checkpoint or table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []
_persisted: list[DataFrame] = []
# Tables persisted inside ``freed_after``; each thread has its own.
_inside: ContextVar[list[DataFrame] | None] = ContextVar("_inside", default=None)


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rewardmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compiled_parts(spark: SparkSession) -> None:
    """Let plans with much text work run as many small compiled functions; a limit set by the user stays.

    The rules of answers and rewards make generated functions of more than 8,000 bytes, which HotSpot
    never compiles. Spark's default lets them run interpreted; above this limit it generates small ones instead.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only when the cluster names none (tests on one machine) is a local one made
    and set, so a cluster never gets a machine-local folder from here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="rewardmill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once into reliable storage; later passes read that, not the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table below the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def released_later(kept: DataFrame) -> DataFrame:
    """Remember a persisted table for the end of ``freed_after`` around the call, else for ``release``."""
    inside = _inside.get()
    (_persisted if inside is None else inside).append(kept)
    return kept


@contextmanager
def freed_after() -> Iterator[None]:
    """Free on leaving, also by an error, the tables that operators persist inside.

    For code that consumes its results itself, as a sink of micro-batches does. Results read
    afterwards are computed again.
    """
    kept: list[DataFrame] = []
    token = _inside.set(kept)
    try:
        yield
    finally:
        _inside.reset(token)
        for df in kept:
            df.unpersist()


def drop_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch tables by path; other paths are left alone."""
    jvm = spark.sparkContext._jvm
    wanted = {jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in paths}
    for known in list(_scratch):
        path = jvm.org.apache.hadoop.fs.Path(known)
        if path.toUri().getPath() in wanted:
            _scratch.remove(known)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Free what operators have kept for results that are no longer needed: persisted and scratch tables.

    Call it when the results built so far have been consumed; results read afterwards that
    rest on a scratch table fail.
    """
    while _persisted:
        _persisted.pop().unpersist()
    jvm = spark.sparkContext._jvm
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
