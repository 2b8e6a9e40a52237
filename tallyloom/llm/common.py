"""What the operators of this subpackage share: table access, written tables, packed columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.shared import drop_but, drop_tables, drop_written, shared_folder, written, written_tables

__all__ = ["drop_but", "drop_tables", "drop_written", "shared_folder", "written", "written_tables"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(column, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it where the input has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Aside:
    """df with its columns under names of our own (c0, c1...), so that columns which operators add clash with none of them; replaced ones are left out."""

    def __init__(self, df: DataFrame, *replaced: str) -> None:
        kept = df.drop(*replaced)
        self.names = kept.columns
        self.rows = kept.toDF(*(f"c{n}" for n in range(len(self.names))))

    def __getitem__(self, name: str) -> Column:
        return F.col(f"c{[n.lower() for n in self.names].index(name.lower())}")

    def back(self) -> list[Column]:
        """The columns under their own names again."""
        return [F.col(f"c{n}").alias(name) for n, name in enumerate(self.names)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns free memory to the system: a worker may lie idle for a while after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of rows at most, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    give_back()
