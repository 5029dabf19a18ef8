"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_shared_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; where it is unset, a temporary folder, but only on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("executors share no local folder: set spark.checkpoint.dir to one that they all reach")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="evidentia-"))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: what follows rereads these rows from the shared folder, whichever executors are lost."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*done: DataFrame) -> None:
    """Removes the files of checkpoints that nothing reads any more; what is no checkpoint is left alone."""
    for df in done:
        plan = df._jdf.queryExecution().logical()
        if plan.nodeName().startswith("LogicalRDD") or plan.getClass().getSimpleName() == "LogicalRDD":
            file = plan.rdd().getCheckpointFile()
            if file.isDefined():
                path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, removed when the driver ends."""
    ensure_shared_dir(spark)
    sc = spark.sparkContext
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        if sc._jsc is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)
    return folder


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A group with at least 1 / HOT_SHARE of the rows is joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row a group, where ``size`` counts a group's rows and one group may hold most of all ``total``."""
    keys = [key] if isinstance(key, str) else key
    hot_rows = max(2, total // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) >= hot_rows))
    cold = groups.filter(F.col(size) < hot_rows)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
