"""Sinks: partitioned writes, versioned replace, append logs."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import checkpoint_dir


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint folder (never machine-local)."""
    return "/".join([checkpoint_dir(spark).rstrip("/"), "ledgerloom", *parts])


def tag(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()[:10]


def for_export(df: DataFrame) -> DataFrame:
    """Export form: timestamps as dates, money numeric (no currency text)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.to_date(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


ACCOUNT_BUCKETS = 64
BUCKET_COL = "casillero_bucket"


def account_bucket(col: str = "casillero", buckets: int = ACCOUNT_BUCKETS):
    """Folder of an account: a bounded hash bucket, never one folder per
    account (accounts grow with the data; folders must not)."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite", buckets: int | None = ACCOUNT_BUCKETS, whole: bool = False) -> None:
    """Write a table clustered by account.

    Default layout: ``casillero_bucket=<k>/`` folders (``buckets`` of them)
    with rows range-partitioned by (bucket, account, row hash) and sorted by
    (bucket, account), so each task writes few files, a hot account spans
    several tasks, and readers prune by folder and by row-group statistics on
    ``casillero``.  With ``partitionOverwriteMode=dynamic`` (session default)
    an overwrite replaces only the buckets present in ``df``; ``whole=True``
    replaces the table.  ``partition_by`` names explicit partition columns
    instead; ``buckets=None`` and no ``partition_by`` writes a flat table.
    """
    tail = F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    parts = [p for p in (partition_by or []) if p in df.columns]
    out = df
    if not parts and buckets and "casillero" in df.columns:
        out = out.withColumn(BUCKET_COL, account_bucket("casillero", buckets))
        out = (out.repartitionByRange(F.col(BUCKET_COL), F.col("casillero"), tail)
               .sortWithinPartitions(BUCKET_COL, "casillero"))
        parts = [BUCKET_COL]
    elif parts:
        out = out.repartitionByRange(*[F.col(p) for p in parts], tail)
    w = out.write.mode(mode).format(fmt)
    if whole:
        w = w.option("partitionOverwriteMode", "static")
    if fmt == "csv":
        w = w.option("header", "true")
    if parts:
        w = w.partitionBy(*parts)
    w.save(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               accounts=None, buckets: int = ACCOUNT_BUCKETS) -> DataFrame:
    """Read a table written by ``write_table`` with its schema (the bucket
    column is dropped).  ``accounts``: only those accounts, pruned to their
    bucket folders before any file is opened; ``buckets`` as written."""
    full = T.StructType(list(schema.fields) + [T.StructField(BUCKET_COL, T.IntegerType())])
    r = spark.read.schema(full).format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
    df = r.load(path)
    if accounts is not None:
        accts = list(accounts)
        df = df.filter(F.col(BUCKET_COL).isin([bucket_of(a, buckets) for a in accts])
                       & F.col("casillero").isin(accts))
    return df.drop(BUCKET_COL)


def bucket_of(acct: str, buckets: int = ACCOUNT_BUCKETS):
    """Bucket of a literal account: a constant that Spark folds, so a filter
    on the partition column prunes folders; no job."""
    return F.pmod(F.xxhash64(F.lit(str(acct))), F.lit(buckets)).cast("int")


def export_report(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the export form of a report; return it read back from the sink."""
    ex = for_export(df)
    write_table(ex, path, fmt=fmt, whole=True)
    return read_table(df.sparkSession, path, ex.schema, fmt=fmt)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file of its own, on any file system Spark knows."""
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    out.write(content)
    out.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions (folders ``_v<N>`` holding ``_SUCCESS``) under root."""
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("_v") and name[2:].isdigit():
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def replace_table(df: DataFrame, root: str, fmt: str = "parquet", partition_by=None) -> str:
    """Whole-table rewrite without MERGE: write a new version folder, then
    readers switch to it (highest complete version).  A failed write leaves
    the previous version current; nothing is overwritten in place.
    """
    spark = df.sparkSession
    v = (versions(spark, root) or [0])[-1] + 1
    path = f"{root.rstrip('/')}/_v{v}"
    write_table(df, path, fmt=fmt, partition_by=partition_by, mode="errorifexists",
                buckets=None if partition_by else ACCOUNT_BUCKETS)
    return path


def read_current(spark: SparkSession, root: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    vs = versions(spark, root)
    if not vs:
        return spark.createDataFrame([], schema)
    return read_table(spark, f"{root.rstrip('/')}/_v{vs[-1]}", schema, fmt=fmt)


def append_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows (e.g. rejects) to a log table; rows without a ``logged_at`` get the time of writing."""
    if "logged_at" not in df.columns:
        df = df.withColumn("logged_at", F.current_timestamp())
    write_table(df, path, fmt=fmt, partition_by=(), mode="append", buckets=None)


__all__ = ["scratch_path", "tag", "for_export", "write_table", "read_table", "export_report",
           "replace_table", "read_current", "append_log", "versions"]
