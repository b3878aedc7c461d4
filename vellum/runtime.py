"""Session helpers shared by every operator: table loading, checkpoints, guarded broadcasts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | None = None, name: str = "vellum") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    cpus = cpus or min(8, os.cpu_count() or 1)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellum-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_columns(folder: str, columns: list[str]) -> Iterator[list[pa.Array]]:
    """The columns of a Parquet folder of the shared file system, batch by batch; for workers, without Spark."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    own = folder.startswith("file:") or "://" not in folder
    f, root = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if own else fs.FileSystem.from_uri(folder)
    for batch in ds.dataset(root, filesystem=f, format="parquet").to_batches(columns=columns):
        yield batch.columns


def guarded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """`broadcast(df)` if it holds at most `max_rows` rows, else `df`, which Spark then joins by shuffling."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
