"""Intermediate tables in the folder that all executors share: lineage ends at files, which go when they are of no more use."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quillwork-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back, until it is released or the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/held-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(_release_all, spark)
    _held.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_path = path
    return out


def release(*tables: DataFrame) -> None:
    for t in tables:
        _remove(t.sparkSession, t.held_path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _held.discard(path)


def _release_all(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        for path in list(_held):
            _remove(spark, path)
