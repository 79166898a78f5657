"""Version history as tables: churn, blame and changed ranges from the text that git prints.

Output is read as (path, line, value) rows, one a line of a captured file, in order by line; nothing is
executed here. States that run over the lines of one output are found in its array of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_state import last_before, split_lines, trim


def churn(log: DataFrame) -> DataFrame:
    """(file, commits) of the lines (value) of a log of names only: blank lines and dot files are left out."""
    name = trim(F.col("value"))
    return log.select(name.alias("file")).filter((F.col("file") != "") & ~F.col("file").startswith(".")).groupBy("file").agg(F.count(F.lit(1)).alias("commits"))


def approximate_date(seconds: Column) -> Column:
    """A day's text from epoch seconds, with years of 365 and months of 30 days as reports count them."""
    days = F.floor(seconds / 86400)
    rest = days - F.floor(days / 365) * 365
    return F.format_string("%04d-%02d-%02d", (1970 + F.floor(days / 365)).cast("int"), (F.floor(rest / 30) + 1).cast("int"), (rest - F.floor(rest / 30) * 30 + 1).cast("int"))


def blame(output: DataFrame) -> DataFrame:
    """(file, line, author, date) of porcelain blame (path: the file, content): a content line, which a tab begins,
    takes the number of the last head and the last author and time before it."""
    rows = split_lines(output)
    head = lambda t: F.when(~t.startswith("\t") & ~t.startswith("author") & (F.length(t) >= 40), F.regexp_extract(t, r"^\S+ (\d+) ", 1).try_cast("int"))
    after = lambda t, k: F.when(t.startswith(k), F.regexp_replace(t, f"^{k}", ""))
    text = F.lit(None).cast("string")
    zipped = F.arrays_zip(
        F.col("ls").alias("t"), last_before(F.col("ls"), head, F.lit(None).cast("int")).alias("line"),
        last_before(F.col("ls"), lambda t: after(t, "author "), text).alias("author"), last_before(F.col("ls"), lambda t: after(t, "author-time "), text).alias("time"),
    )
    each = rows.select(F.col("path").alias("file"), F.explode(zipped).alias("l")).filter(F.col("l.t").startswith("\t") & F.col("l.line").isNotNull())
    return each.select("file", "l.line", "l.author", approximate_date(F.col("l.time").try_cast("bigint")).alias("date"))


def hunks(diffs: DataFrame, extension: str = ".rs") -> DataFrame:
    """(file, start_line, end_line) of the new side of diffs (path, content) without context: a range's file is that
    of the last head before it, and only files of that extension count."""
    new_file = lambda t: F.when(t.startswith("diff --git "), F.coalesce(F.get(F.split(t, r"\s+"), F.lit(3)), F.lit("")))
    rows = split_lines(diffs)
    zipped = F.arrays_zip(F.col("ls").alias("t"), last_before(F.col("ls"), new_file, F.lit("")).alias("file"))
    each = rows.select(F.explode(zipped).alias("l")).filter(F.col("l.t").startswith("@@") & F.col("l.file").startswith("b/") & F.col("l.file").endswith(extension))
    new = r"^@+\s*\S+\s+\+?(\d+)(?:,(\d+))?"
    start, count = F.regexp_extract("l.t", new, 1).try_cast("int"), F.regexp_extract("l.t", new, 2)
    n = F.when(count == "", 1).otherwise(count.try_cast("int"))
    return each.select(F.substr("l.file", F.lit(3)).alias("file"), start.alias("start_line"), (start + F.greatest(n - 1, F.lit(0))).alias("end_line")).filter("start_line is not null")


def with_blame(rows: DataFrame, blamed: DataFrame) -> DataFrame:
    """rows (file, line, ...) with author and date of their line, null where it has none."""
    return rows.join(blamed.select("file", "line", "author", "date"), ["file", "line"], "left")


def by_author(rows: DataFrame) -> DataFrame:
    """(author, n) of rows with an author."""
    return rows.filter("author is not null").groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def fingerprints(files: DataFrame, version: str) -> DataFrame:
    """(project, fingerprint) of (project, path, content): alike as long as no file and no rule version changes.
    Files are hashed one by one, and a project's hash is of their sorted hashes, 32 bytes a file."""
    each = files.select("project", F.sha2(F.concat_ws("\x00", "path", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)).cast("binary"), 256).alias("h"))
    whole = F.sha2(F.concat(F.lit(version), F.array_join(F.array_sort(F.collect_list("h")), "")).cast("binary"), 256)
    return each.groupBy("project").agg(whole.alias("fingerprint"))
