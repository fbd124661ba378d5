"""Session settings and the folder that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTITION_BYTES = 128 * 1024 * 1024

# Rows of a few numbers and short texts: some ten megabytes on each executor.
BROADCAST_ROWS = 200_000

# Paths below the shared folder that this process has named.
_copies: list[str] = []


def broadcast_rows(df: DataFrame, at_most: int) -> DataFrame:
    """Broadcast a narrow frame of a known largest size; a larger one is left to the optimizer."""
    return F.broadcast(df) if at_most <= BROADCAST_ROWS else df


def scale_settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job whose widest shuffle moves ``shuffle_bytes``.

    Shuffle partitions stay near 128 MB so that sorts and hash tables fit in executor memory; AQE
    merges the small ones and splits the skewed ones.
    """
    wanted = max(math.ceil(shuffle_bytes / _PARTITION_BYTES), cores)
    return {
        "spark.sql.shuffle.partitions": str(math.ceil(wanted / cores) * cores),
        "spark.sql.files.maxPartitionBytes": str(_PARTITION_BYTES),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(_PARTITION_BYTES),
    }


def local_session(app: str, cpus: int, memory: str = "8g") -> SparkSession:
    """A single-machine session, as tests and bench use it."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, that of the application.

    On a cluster a ``file:`` folder must be a mount that all machines share, which cannot be told
    from its name: a warning says so. Only in local mode a scratch folder stands in, and becomes that of the application.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if str(folder).startswith("file:") and not context.master.startswith("local"):
        warnings.warn(f"{folder} must be a mount that all executors share", stacklevel=2)
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="meterlight-"))
        folder = context.getCheckpointDir()
    return folder


def new_shared_path(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _copies.append(path)
    return path


def remove_copies(spark: SparkSession, purpose: str = "") -> list[str]:
    """Delete what this process has stored below the shared folder; returns the paths.

    ``purpose`` (such as ``numbered``) limits it to copies made for that. Frames that still read
    a copy cannot be used afterwards.
    """
    gone = [path for path in _copies if path.rpartition("/")[2].startswith(purpose)]
    for path in gone:
        delete_path(spark, path)
        _copies.remove(path)
    return gone


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder wherever Spark can reach it; nothing happens if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
