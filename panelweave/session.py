"""Session settings used by the tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "panelweave") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PANELWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def stage_dir(spark: SparkSession) -> str:
    """Folder for stage tables: the cluster's shared checkpoint folder.

    A machine-local folder is made only where no shared one is named, which is the
    case in local tests and never on a cluster.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="panelweave-", dir="/tmp")
    return _LOCAL_DIRS[app]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the stage folder, deleted by ``drop_stages``."""
    path = f"{stage_dir(spark)}/panelweave-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used where a result feeds several branches: the branches then read a table of known
    size instead of repeating the work, and a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_mark(spark: SparkSession) -> int:
    """How many stage tables this session has written; what comes later can be dropped on its own."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_stages(spark: SparkSession, since: int = 0, keep_last: bool = False) -> int:
    """Delete the stage tables this session wrote after the mark ``since``; call it when their results are no longer read.

    ``keep_last`` leaves the last one, say a result that was made from the others.
    """
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    paths = written[since : len(written) - 1 if keep_last else None]
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        written.remove(path)
    return len(paths)
