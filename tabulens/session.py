"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g", name: str = "tabulens") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    The session names it in ``spark.checkpoint.dir``. Only a local master, where all tasks run in
    one process, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tabulens-")  # one process, so all tasks see it
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy.

    Used where later steps must see exactly one evaluation (partition ids of a
    range partitioning) and survives the loss of any executor.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _put(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return folder, df.sparkSession.read.schema(df.schema).parquet(folder)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: evaluated once, columns still prunable."""
    return _put(df, name)[1]


@contextmanager
def written(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """Like ``settled``, for readers that end with the context: the folder is deleted then."""
    folder, found = _put(df, name)
    try:
        yield found
    finally:
        remove(df.sparkSession, folder)
