"""Tables in and out: scans with their required columns, atomic publishing, sidecars, digests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmark.functions.sequences import parse_base, parse_mass, parse_times

#: Names of Parquet codecs on the command line and in Spark.
CODECS = {"zstd": "zstd", "snappy": "snappy", "gzip": "gzip", "lz4": "lz4_raw", "none": "uncompressed"}


def scan(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """A Parquet table; it must have these columns, and only they are read."""
    df = spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path}: no columns {missing}")
    return df.select(*columns)


def scan_base(raw: DataFrame) -> DataFrame:
    return raw.select("IP_ADDR", F.expr(parse_base("IPID_SEQUENCE")).alias("ipids"))


def scan_mass(raw: DataFrame) -> DataFrame:
    return raw.select("IP_ADDR", F.expr(parse_mass("IPID_SEQUENCE")).alias("ipids"))


def scan_times(raw: DataFrame) -> DataFrame:
    return raw.select("IP_ADDR", F.expr(parse_times("SEND_TIMESTAMP_SEQUENCE")).alias("times"))


def scan_strategies(spark: SparkSession, path: str) -> DataFrame:
    df = scan(spark, path, ["IP_ADDR", "IPID_SELECTION_STRATEGY"])
    return df.withColumn("IPID_SELECTION_STRATEGY", F.col("IPID_SELECTION_STRATEGY").cast("string"))


def store(spark: SparkSession, uri: str):
    """The Hadoop file system that holds a URI, and the URI as its path: local, s3a and any other that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """URIs that match a glob pattern, in order; none if nothing does."""
    files, path = store(spark, pattern)
    return sorted(f.getPath().toString() for f in files.globStatus(path) or [])


def exists(spark: SparkSession, uri: str) -> bool:
    """Whether exactly this URI is there; a prefix of other names does not count."""
    files, path = store(spark, uri)
    return files.exists(path)


def read_text(spark: SparkSession, uri: str) -> str:
    """A small text file as a whole."""
    files, path = store(spark, uri)
    stream = files.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename source to target. What stood at target is first put aside and goes only after the new one is in place; if that fails, it is put back."""
    (files, new), (_, path), (_, old) = store(spark, source), store(spark, target), store(spark, f"{target.rstrip('/')}.{uuid.uuid4().hex}.old")
    before = files.exists(path)
    if before and not files.rename(path, old):
        raise OSError(f"cannot put {target} aside")
    if not files.rename(new, path):
        if before:
            files.rename(old, path)
        raise OSError(f"cannot rename {source} to {target}")
    if before:
        files.delete(old, True)


def publish(df: DataFrame, path: str, codec: str = "zstd") -> str:
    """Write beside the path and rename, so a reader sees whole tables only; on failure the old table stays and nothing else is left."""
    spark = df.sparkSession
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        df.write.option("compression", CODECS[codec]).parquet(part)
        replace(spark, part, path)
    finally:
        files, source = store(spark, part)
        if files.exists(source):
            files.delete(source, True)
    return path


def import_strategies(spark: SparkSession, source: str, target: str, codec: str = "zstd") -> int:
    """Publish a persisted strategy table under another name; its rows."""
    df = spark.read.parquet(source)
    if df.columns != ["IP_ADDR", "IPID_SELECTION_STRATEGY"]:
        raise ValueError(f"{source}: not a strategy table: {df.columns}")
    publish(scan_strategies(spark, source), target, codec)
    return spark.read.parquet(target).count()


def write_json(spark: SparkSession, uri: str, data: dict) -> None:
    """A small sidecar, sorted keys, renamed into place."""
    part = f"{uri}.{uuid.uuid4().hex}.part"
    files, path = store(spark, part)
    stream = files.create(path)
    stream.write(bytearray(json.dumps(data, indent=2, sort_keys=True).encode()))
    stream.close()
    replace(spark, part, uri)


def digest(spark: SparkSession, uris: Iterable[str]) -> dict:
    """Bytes and SHA-256 of files, in their order, as one stream."""
    jvm, size = spark.sparkContext._jvm, 0
    sha = jvm.java.security.MessageDigest.getInstance("SHA-256")
    for uri in uris:
        files, path = store(spark, uri)
        stream = jvm.java.security.DigestInputStream(files.open(path), sha)
        size += jvm.org.apache.commons.io.IOUtils.consume(stream)
        stream.close()
    return {"size_bytes": size, "sha256": bytes(sha.digest()).hex()}
