"""Tables in the folder that driver and executors share: written once, read back, dropped when nothing reads them any more."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that were written and not dropped yet.
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a folder of our own if all runs on this machine, else an error: executors elsewhere could not read it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table into the shared folder and read back, which cuts its lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def written_tables() -> list[str]:
    return list(_tables)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes some of the tables that written() made; only once nothing reads them any more."""
    for where in paths:
        if where in _tables:
            _tables.remove(where)
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_but(spark: SparkSession, before: list[str], *kept: DataFrame) -> None:
    """Deletes what has been written since before (see written_tables) but for the tables kept, which are as written() gave them."""
    needed = {*before, *(df.written_path for df in kept)}
    drop_tables(spark, [t for t in written_tables() if t not in needed])


def drop_written(spark: SparkSession) -> None:
    drop_tables(spark, written_tables())
