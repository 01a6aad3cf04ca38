"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "sweepledger", cpus: str = "*") -> SparkSession:
    """A session for tests and the bench on one machine.

    On a cluster the submitter's own settings apply; nothing below is needed there.
    """
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session that names none gets a temporary folder; on a cluster such a folder
    would be lost with its machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="sweepledger-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, which all executors share. It is noted, see ``drop_scratch``."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch(spark).append(path)
    return path


def _scratch(spark: SparkSession) -> list[str]:
    """The scratch folders of the application that were not dropped together."""
    context = spark.sparkContext
    if not hasattr(context, "_sweepledger_scratch"):
        context._sweepledger_scratch = []
    return context._sweepledger_scratch


def scratch_mark(spark: SparkSession) -> int:
    """Where scratch folders made from now on begin, for ``drop_scratch``."""
    return len(_scratch(spark))


def scratch_since(spark: SparkSession, mark: int) -> list[str]:
    """The scratch folders made since a mark that were not dropped."""
    return list(_scratch(spark)[mark:])


def drop_scratch(spark: SparkSession, since: int, keep: Sequence[str] = ()) -> int:
    """Delete the scratch folders made since a mark but those in ``keep``; how many. For callers whose results are written,
    because frames made in between may still read these folders."""
    noted = _scratch(spark)
    gone = [path for path in noted[since:] if path not in keep]
    noted[since:] = [path for path in noted[since:] if path in keep]
    for path in gone:
        drop_stage(spark, path)
    return len(gone)


def tidy(job: Callable) -> Callable:
    """A job that leaves no scratch folder behind, whether it ends well or not; its first argument is the session."""

    @wraps(job)
    def run(spark: SparkSession, *args, **kwargs):
        mark = scratch_mark(spark)
        try:
            return job(spark, *args, **kwargs)
        finally:
            drop_scratch(spark, mark)

    return run


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it from there.

    For tables that several branches of a plan read and that are costly to make.
    """
    return stage_at(df, name, compression)[0]


def stage_at(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """As ``stage``, with the folder, for callers that drop it when they are done with it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``stage_at``, when nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
