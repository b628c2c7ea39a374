"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a temporary one if all run on this
    machine; on a cluster that is an error, since executors wouldn't see it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dayscribe-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def dealt(df: DataFrame, most: int | None = None) -> DataFrame:
    """df dealt out to as many tasks as shuffles have, if it is read in no more splits than these, or than most: so little data, often in one
    split of them, is moved for work that is all computing. A table of more splits is worked on where it is read."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() > (tasks if most is None else most) else df.repartition(tasks)


def staged(df: DataFrame, name: str = "stage", by: str | None = None, **options: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors. by: a column whose values get
    folders of their own, so that a filter on it leaves the other files alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, per_key: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """rows joined with per_key, a row a key (without nulls) with the number of its rows in column count, which is dropped.

    Keys of over a thousandth of all rows (total) are broadcast: there are fewer than a thousand. The others are
    joined by an ordinary shuffle, so no task gets more than a thousandth for one key."""
    hot = F.col(count) > max(64, total // 1000)
    named = F.broadcast(per_key.filter(hot).drop(count))
    rest = rows.join(named.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(per_key.filter(~hot).drop(count), key)
    return rows.join(named, key).unionByName(rest)
