"""Records in files: line-delimited JSON with a tolerance, tables of calls, pages, and writes that are seen whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, skip_corrupt: bool = False, missing_ok: bool = False) -> DataFrame:
    """One record a line; only a line feed ends a record, and blank lines don't count.

    A line that can't be read is an error that doesn't quote it. With skip_corrupt, two such lines or one in a hundred are passed over. With
    missing_ok a path that isn't there has no records.
    """
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], kind)
    lines = spark.read.option("lineSep", "\n").text(path).where("trim(value) <> ''")
    wide = T.StructType([*kind.fields, T.StructField(_BAD, T.StringType())])
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"))
    total, bad = parsed.agg(F.count(F.lit(1)), F.count(F.when(F.col(f"r.{_BAD}").isNotNull() | F.col("r").isNull(), 1))).collect()[0]
    if bad > (max(2, total // 100) if skip_corrupt else 0):
        raise ValueError(f"{bad} of {total} records can't be read")
    return parsed.where(F.col("r").isNotNull() & F.col(f"r.{_BAD}").isNull()).select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in kind.fields))


def count_records(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank, whether they can be read or not."""
    return spark.read.option("lineSep", "\n").text(path).where("trim(value) <> ''").count()


def write_whole(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes beside the path; then the old table is renamed aside, the new one to the path, and the old one deleted. A crash loses neither: one of both is under the path or beside it.
    Between the two renames a reader finds nothing."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.format(kind).save(staged)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    there = files.exists(old)
    if there and not files.rename(old, aside):
        raise OSError(f"{path} can't be renamed")
    if not files.rename(new, old):
        if there:
            files.rename(aside, old)
        raise OSError(f"{staged} can't be renamed")
    if there:
        files.delete(aside, True)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


CALLS = ("call_id", "language", "label", "tactic_ids", "caller_number", "transcript_file", "audio_file", "consent_ref")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """A table of calls: the header must be CALLS, cells are trimmed, tactic_ids are split at semicolons; no rows or repeated ids are an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CALLS])
    head = spark.read.option("lineSep", "\n").text(path).first()
    if head is None or tuple(head[0].rstrip("\r").split(",")) != CALLS:
        raise ValueError("the header isn't that of a table of calls")
    rows = spark.read.schema(schema).option("header", True).csv(path).select(*(F.trim(c).alias(c) for c in CALLS))
    n, ids = rows.agg(F.count(F.lit(1)), F.countDistinct("call_id")).collect()[0]
    if not n or n != ids:
        raise ValueError("no calls, or repeated ids")
    return rows.withColumn("tactic_ids", F.filter(F.transform(F.split("tactic_ids", ";"), lambda t: F.trim(t)), lambda t: t != ""))


def embedded(rows: DataFrame, cache: DataFrame, embed, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """rows with embedding, and the cache (h, embedding) with what was new. embed maps a table of h and text, different texts only, to h and embedding."""
    keyed = rows.withColumn("h", F.sha2(text, 256))
    new = keyed.select("h", F.col(text).alias("text")).dropDuplicates(["h"]).join(cache.select("h"), "h", "left_anti")
    full = cache.unionByName(embed(new))
    return keyed.join(full, "h", "left").drop("h"), full


def html_text(html: Column) -> Column:
    """A page as lines: scripts and styles gone, line breaks and ends of blocks as line ends, other tags as blanks, the commonest entities decoded, blanks squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p\s*>|</div\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\x0b\x0c ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def spoken_lines(text: Column) -> Column:
    """speaker and text of each line that isn't blank; a speaker is a word before a colon, without blanks, else "speaker"."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.when(x.rlike(r"^[^\s:]+:\s*\S"), F.regexp_extract(x, r"^([^\s:]+):", 1)).otherwise("speaker").alias("speaker"), F.when(x.rlike(r"^[^\s:]+:\s*\S"), F.regexp_extract(x, r"^[^\s:]+:\s*(.*)$", 1)).otherwise(x).alias("text")))
