"""Spark session settings and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

TARGET_PARTITION_BYTES = 128 * 1024 * 1024
# While tables are stored: at most about so many enrolments, or bytes of a shuffle, a task.
TASK_ROWS = 500_000
TASK_BYTES = 16 * 1024 * 1024
# Folders that a task may write to at once without sorting its rows by folder first.
OPEN_FOLDERS = 32


def shuffle_partitions(input_bytes: int, total_cores: int) -> int:
    """Initial shuffle partitions: about 128 MB each, never fewer than the cores.

    AQE merges small partitions at run time but cannot split below this number
    (other than for skewed joins), so it has to follow the input size.
    """
    return max(total_cores, -(-input_bytes // TARGET_PARTITION_BYTES))


def _bytes(size: str) -> int:
    """A size as Spark's settings have it: 64MB, 8m, 1024."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[int]:
    """Shuffles of tables with `rows` rows get tasks of a bounded size inside; yields their number.

    A hash aggregate or sort takes the memory of its task's rows, so their number may not
    grow with the input. The settings only become finer, and are as before afterwards.
    """
    parts, size, folders = (
        "spark.sql.shuffle.partitions",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.maxConcurrentOutputFileWriters",
    )
    before = {name: spark.conf.get(name) for name in (parts, size, folders)}
    number = max(int(before[parts]), -(-rows // TASK_ROWS))
    finer = {
        parts: str(number),
        size: str(min(_bytes(before[size]), TASK_BYTES)),
        folders: str(max(int(before[folders]), OPEN_FOLDERS)),
    }
    try:
        for name, value in finer.items():
            spark.conf.set(name, value)
        yield number
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def build_session(
    app: str = "examlens",
    master: str | None = None,
    input_bytes: int = 0,
    total_cores: int = 8,
    **conf: str,
) -> SparkSession:
    """A session with the settings the operators are designed for.

    AQE re-plans joins from measured sizes (broadcast only below the threshold, hash
    join without sorting the facts where every partition of the other side is small)
    and splits the partitions of hot join keys. The number of shuffle partitions is left
    to the cluster unless `input_bytes` says how much is read; a configured number is
    raised to what that needs and never lowered.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    if input_bytes:
        needed, name = shuffle_partitions(input_bytes, total_cores), "spark.sql.shuffle.partitions"
        if session.sparkContext.getConf().contains(name):
            needed = max(needed, int(session.conf.get(name)))
        session.conf.set(name, str(needed))
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="examlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Let `DataFrame.checkpoint` write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
