"""Joins of line ranges: by bucket of lines where files are equal, and by the end of the path where they aren't.

A range is dealt to the buckets of LINES lines that it covers, so that an equi-join on (file, bucket) brings together
only what lies near, however many ranges a file has. Paths that end in another are found by hashes of their endings,
of the lengths that are asked for alone: no key is shared by all files of one name.

Rows that an explode makes are many times what Spark estimates, by the bytes of the columns read. So both sides of a
join on them are dealt out (shuffled): a table that is taken for a small one would go whole through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = 64


def dealt(df: DataFrame) -> DataFrame:
    """df, whose next join shuffles both sides, whatever their estimated sizes."""
    return df.hint("merge")


def buckets(first: Column, last: Column) -> Column:
    """The buckets that the lines from first to last lie in, a row each."""
    at = lambda c: F.floor(c / LINES)
    return F.explode(F.when(last >= first, F.sequence(at(first), at(last))))


def ending(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """(file, end) of all distinct paths (file) and ends (end) such that the path ends in it."""
    asked = ends.select("end").distinct().withColumn("size", F.length("end")).withColumn("key", F.xxhash64("end"))
    sizes = asked.agg(F.collect_set("size").alias("sizes"))  # as many numbers at most as a path is long
    each = paths.select("file").distinct().crossJoin(F.broadcast(sizes))
    each = each.select("file", F.explode(F.filter("sizes", lambda n: n <= F.length("file"))).alias("size"))
    keyed = each.withColumn("key", F.xxhash64(F.right("file", F.col("size"))))
    return dealt(keyed).join(asked, ["size", "key"]).filter(F.endswith("file", "end")).select("file", "end")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both (file, first, last, ...) whose lines meet, once a pair; other columns have different names."""
    a = left.withColumn("bucket", buckets(F.col("first"), F.col("last"))).alias("a")
    b = right.withColumnsRenamed({"first": "first2", "last": "last2"}).withColumn("bucket", buckets(F.col("first2"), F.col("last2"))).alias("b")
    met = dealt(a).join(b, ["file", "bucket"]).filter((F.col("first") <= F.col("last2")) & (F.col("last") >= F.col("first2")))
    # two ranges may share several buckets: the first of them speaks for the pair
    return met.filter(F.col("bucket") == F.floor(F.greatest("first", "first2") / LINES)).drop("bucket")
