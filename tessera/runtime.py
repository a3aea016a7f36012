"""Session helpers: reading tables, cutting lineage, partition counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data directory, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session without one gets a temporary one."""
    sc = spark.sparkContext
    set_to = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_to = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(set_to)
    return set_to


def folder(spark: SparkSession) -> str:
    """A new place in the shared folder, below one of this application, which goes when the program ends."""
    own = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the session's file systems; one that can't be reached any more (a stopped session) stays."""
    with suppress(Exception):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows live in the shared folder and the plan starts anew."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back (smaller than a checkpoint for wide rows)."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """Broadcast when counted to be small, else left to the planner."""
    return F.broadcast(df) if df.count() <= most else df


def dealt(df: DataFrame) -> DataFrame:
    """Join by shuffle, never by broadcast: for sides with as many rows as there are nodes, of which the planner knows the
    size of packed files only."""
    return df.hint("merge")


def batches_by_bytes(spark: SparkSession, most: int = 4 << 20) -> None:
    """Send rows to Python in batches of about ``most`` bytes, so that a worker's memory does not follow the length of
    texts; a session that sets its own bound keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(most))
