"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: str = "*", name: str = "panelweave", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is only ever chosen in local mode, where the driver is the one executor. The
    folder and what checkpoints and queries leave in it are removed when the application ends.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get(CHECKPOINT_SETTING, None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="panelweave-"))
    # The folder is the application's own, below the one that the cluster names.
    folder = context.getCheckpointDir()
    target = context._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return folder


def checkpointed(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small aggregates that several later steps read."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


@contextmanager
def staged(frame: DataFrame, keep_plan: bool = False) -> Iterator[DataFrame]:
    """Write `frame` once and hand out the written table, for work that reads it many times.

    A lost executor then costs a re-read of files, not a rerun of every shuffle above. Rows are
    rebalanced before the write, so that a narrow sub-population of a large survey does not end up in
    many tiny files, nor a few large files in a few tasks. The table is removed on exit, so nothing
    lazy may outlive the block. `keep_plan` skips the write, for frames read from a staged table.
    """
    if keep_plan:
        yield frame
        return
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/panelweave-{uuid.uuid4().hex}"
    frame.hint("rebalance").write.parquet(path)
    try:
        yield spark.read.schema(frame.schema).parquet(path)
    finally:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
