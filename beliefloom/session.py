"""Session helpers: building a session, cutting lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(app: str = "beliefloom", cores: str = "*", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine assumes (UTC, adaptive execution); conf overrides any of them.

    Without ``master`` it is local, with a shuffle partition for each core; a cluster's number of partitions is its own.
    """
    builder = (
        SparkSession.builder.master(master or f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master is None:
        builder = builder.config("spark.sql.shuffle.partitions", cores if cores.isdigit() else str(os.cpu_count() or 8))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names it.  Only a local master may fall back to a folder of this machine; on a cluster
    a missing setting is an error, because executors could not read one another's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="beliefloom-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _run_dir(spark: SparkSession) -> str:
    """This session's own folder below the shared one; removed when the interpreter or the driver's JVM ends."""
    key = spark.sparkContext.applicationId
    if key not in _RUNS:
        _RUNS[key] = f"{checkpoint_dir(spark)}/beliefloom-{uuid.uuid4().hex}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_RUNS[key])
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        # The file system outlives the session, so the folder goes even if the session was stopped before.
        atexit.register(lambda: fs.delete(at, True))
    return _RUNS[key]


_RUNS: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written as a table in the shared checkpoint folder; later plans start from its files.

    Unlike a checkpointed RDD the table has a known size (for the choice of joins), is read by column, and carries no
    inferred constraints of the plan that made it, which would grow with every step of a loop.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._beliefloom_path = path
    return out


def cut_counting(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """cut(df), and aggregates over it that the same job computes (0 where there is no row)."""
    seen = Observation()
    out = cut(df.observe(seen, *(c.alias(n) for n, c in figures.items())))
    got = seen.get
    return out, {n: got.get(n) or 0 for n in figures}


def cut_split(df: DataFrame, flag: str, **figures: Column) -> tuple[DataFrame, DataFrame, dict]:
    """cut_counting(df), read as the rows whose boolean column ``flag`` is true and those where it is false, without it.

    The two parts are files of their own, so each can be released without the other.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    counted = df.observe(seen, *(c.alias(n) for n, c in figures.items())) if figures else df
    counted.write.option("compression", "lz4").partitionBy(flag).parquet(path)
    got = seen.get if figures else {}
    whole = spark.read.schema(df.schema).parquet(path)
    parts = []
    for value in (True, False):
        part = whole.where(F.col(flag) == F.lit(value)).drop(flag)
        part._beliefloom_path = f"{path}/{flag}={str(value).lower()}"
        parts.append(part)
    return parts[0], parts[1], {n: got.get(n) or 0 for n in figures}


def release(*dfs: DataFrame | None) -> None:
    """Deletes the files of tables made by cut() that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_beliefloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if it is a plain scan in far fewer parts than there are cores.

    Small files come in one part, which would leave all work on them to one core; inputs of some size are left as they are.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "AdaptiveSparkPlan" in plan or "Exchange" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 4 <= cores else df


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, hinted for broadcast only if it is proven to have at most ``rows`` rows (counted up to that bound)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def empty(df: DataFrame) -> bool:
    return df.isEmpty()
