"""Tables that outlive a task: checkpoints and folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, object] = {}


def once[X](key: str, make: Callable[[], X], most: int = 2) -> X:
    """What ``make`` gave for ``key`` in this process: a worker builds an automaton once, not once a task. The last ``most`` are kept."""
    if key not in _MADE:
        while len(_MADE) >= most:
            del _MADE[next(iter(_MADE))]
        _MADE[key] = make()
    return _MADE[key]  # type: ignore[return-value]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) a fresh local folder is
    made and set as the checkpoint folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glyphline-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``fresh_dir`` by the file system that its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage ends there and a
    lost executor costs no recomputation. Spark removes the files once the
    frame is no longer referenced (``cleanCheckpoints``)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt evenly to all cores, for costly work on each row.

    A task of a scan has whole row groups (up to a million rows in many writers), and
    some have none, so a file with few of them leaves most cores idle. To be used on
    narrow rows, before texts are made of them, or where texts move nowhere else.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
