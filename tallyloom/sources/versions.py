"""Tables that are replaced as a whole: a commit writes several tables into a folder of its own, and then puts a small file with the next number, which only one writer can.

Readers take the newest number and read its folder, so they see the old tables or the new ones, never none or half; a reader that holds a version keeps it until it is cleared. A
commit can carry a token, such as a batch's id: of commits with one token only the first counts.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import keyed_hash

_DIGITS = 12
#: Seconds in which a writer tells what the number is that it has claimed.
WAIT = 5.0


class Conflict(Exception):
    """Another writer has committed since the version that a commit is based on."""


@dataclass(frozen=True)
class Version:
    path: str
    number: int
    folder: str
    tables: dict[str, int]
    tokens: tuple[str, ...]

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """A table of this version; an error if files of it are gone, by its count of rows."""
        found = spark.read.parquet(f"{self.folder}/{table}")
        rows = found.count()
        if rows != self.tables[table]:
            raise ValueError(f"{table} has {rows} rows instead of {self.tables[table]}")
        return found


class Versions:
    def __init__(self, spark: SparkSession, path: str, tokens: int = 1000) -> None:
        """tokens: how many of the newest commits' tokens are remembered."""
        self.spark, self.path, self.remembered = spark, path.rstrip("/"), tokens
        self.log = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        self.files = self.log.getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self.files.exists(self.log):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.log)]
        return sorted(int(n) for n in names if n.isdigit())

    def _told(self, number: int) -> Version | None:
        """None where a writer has claimed the number but not told what it is yet."""
        stream = self.files.open(self.spark._jvm.org.apache.hadoop.fs.Path(self.log, f"{number:0{_DIGITS}d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not text.endswith("\n"):
            return None
        told = json.loads(text)
        return Version(self.path, number, f"{self.path}/{told['folder']}", told["tables"], tuple(told["tokens"]))

    def latest(self) -> Version | None:
        for number in reversed(self._numbers()):
            if found := self._told(number):
                return found
        return None

    def _settled(self) -> Version | None:
        """The newest version, once claims after it have been told; one that isn't within WAIT seconds is a writer that has died."""
        until = time.monotonic() + WAIT
        while True:
            numbers, found = self._numbers(), self.latest()
            if not numbers or found and found.number == numbers[-1] or time.monotonic() > until:
                return found
            time.sleep(0.05)

    def at(self, number: int) -> Version:
        found = self._told(number) if number in self._numbers() else None
        if not found:
            raise ValueError(f"{self.path} has no version {number}")
        return found

    def _claim(self, number: int, told: dict) -> bool:
        """Puts the file of a number if nobody has it yet."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.log, f"{number:0{_DIGITS}d}")
        try:
            out = self.files.create(where, False)
        except Exception:
            if self.files.exists(where):
                return False
            raise
        try:
            out.write(bytearray((json.dumps(told) + "\n").encode()))
        finally:
            out.close()
        return True

    def commit(self, tables: dict[str, DataFrame], token: str | None = None, based_on: Version | None | str = "any") -> Version:
        """Writes tables as the next version. based_on: the version that they were made from (None: there was none); Conflict if another one has come since. With a known token nothing is written."""
        before = self.latest()
        if token is not None and before and token in before.tokens:
            return before
        folder, rows = f"data-{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
            rows[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}/{name}").count()
        while True:
            now = self._settled()
            if based_on != "any" and (now.number if now else None) != (based_on.number if based_on else None):
                self._drop(folder)
                raise Conflict(self.path)
            tokens = now.tokens if now else ()
            if token is not None and token in tokens:
                self._drop(folder)
                return now
            number = max(self._numbers(), default=0) + 1
            told = {"folder": folder, "tables": rows, "tokens": [*tokens, *([token] if token is not None else [])][-self.remembered :]}
            if self._claim(number, told):
                return self.at(number)

    def _drop(self, folder: str) -> None:
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"), True)

    def clear(self, keep: int = 2) -> int:
        """Deletes all versions but the newest ones, and folders of commits that none of them names; only while nobody commits. How many versions went."""
        numbers = self._numbers()
        kept = [v for v in map(self._told, numbers[-keep:]) if v]
        for number in numbers[:-keep]:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.log, f"{number:0{_DIGITS}d}"), False)
        root, named = self.spark._jvm.org.apache.hadoop.fs.Path(self.path), {v.folder.rsplit("/", 1)[1] for v in kept}
        for status in self.files.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("data-") and name not in named:
                self._drop(name)
        return len(numbers[:-keep])


def checked_embeddings(embeddings: DataFrame, row_id: str = "id", vector: str = "embedding") -> DataFrame:
    """embeddings, if every row has an id, no id comes twice and all vectors have one length without nulls; else an error that says what is wrong."""
    n, ids, named, short, long = embeddings.agg(
        F.count(F.lit(1)), F.countDistinct(row_id), F.count(row_id), F.min(F.when(F.col(vector).isNull() | F.exists(vector, lambda e: e.isNull()), -1).otherwise(F.size(vector))), F.max(F.size(vector))
    ).collect()[0]
    if named != n or ids != n:
        raise ValueError(f"{n} embeddings have {ids} different ids")
    if n and (short < 1 or short != long):
        raise ValueError("embeddings differ in length, or have nulls")
    return embeddings


def call_tables(calls: DataFrame, key: bytes, row_id: str = "call_id", text: str = "text", number: str = "caller_number") -> dict[str, DataFrame]:
    """calls (masked already) as tables that are kept apart: dialogues without the number, with the digest of their text; and numbers, keyed digests by call. Without a number a call has no row there."""
    return {
        "dialogues": calls.drop(number).withColumn("content_sha256", F.sha2(F.coalesce(text, F.lit("")), 256)),
        "numbers": calls.where(F.col(number).isNotNull()).select(row_id, keyed_hash(F.col(number), key).alias("number_hash")).where("number_hash is not null"),
    }
