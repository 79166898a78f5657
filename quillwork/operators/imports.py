"""Imports of source lines by language: what a module depends on.

Declarations are read from single lines by pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import extension
from .metrics import workspace_import

SCRIPT, C_LIKE = ("js", "mjs", "cjs", "ts", "tsx", "mts"), ("c", "h", "cpp", "cc", "cxx", "hpp")
QUOTED = "[\"']([^\"']*)[\"']"


def _after(t: Column, keyword: str) -> Column:
    """What a keyword names, without the semicolons at the end."""
    return F.when(t.startswith(keyword), F.trim(F.regexp_replace(F.substr(t, F.lit(len(keyword) + 1)), ";+$", "")))


def module(trimmed: Column, ext: Column) -> Column:
    """The module that a line imports, null or "" if none."""
    t = trimmed
    quoted = F.regexp_extract(t, QUOTED, 1)
    java = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^import (static )?", ""), ";+$", ""), r"\.\*$", "")
    required = F.regexp_extract(t, r"\brequire\([\"'`]([^\"'`]*)[\"'`]\)", 1)
    return (
        F.when(ext == "rs", _after(t, "use "))
        .when(ext.isin("py", "pyi"), F.when(t.startswith("from "), F.regexp_extract(t, r"^from (\S+) import ", 1)).when(t.startswith("import "), F.regexp_extract(t, r"^import ([^\s,;]+)", 1)))
        .when(ext.isin(*SCRIPT), F.when(t.startswith("import "), quoted).otherwise(required))
        .when(ext == "go", F.when(t.rlike(r'^(?:import )?(?:\w+ )?"[^"]*"$'), F.regexp_extract(t, '"([^"]*)"', 1)))
        .when(ext.isin(*C_LIKE), F.regexp_extract(t, r'^#\s*include\s*[<"]([^>"]*)[>"]', 1))
        .when(ext == "cs", _after(t, "using ")).when(ext.isin("swift", "kt"), _after(t, "import ")).when(ext == "java", F.when(t.startswith("import "), F.trim(java)))
        .when(ext == "php", F.coalesce(_after(t, "use "), F.when(t.rlike("^(include|require)"), quoted)))
        .when(ext == "rb", F.when(t.rlike("^(require|require_relative|load) "), quoted).otherwise(_after(t, "include ")))
        .when(ext == "sol", F.when(t.startswith("import "), quoted))
    )


def imports(lines: DataFrame) -> DataFrame:
    """(file, line, module) of lines (path, line, trimmed)."""
    return lines.select(F.col("path").alias("file"), "line", module(F.col("trimmed"), extension(F.col("path"))).alias("module")).filter("module <> ''")


def module_graph(lines: DataFrame) -> DataFrame:
    """(src, dst) of lines (path, line, trimmed): files and the modules of the same workspace that they import, once each."""
    found = imports(lines)
    return found.filter(workspace_import(F.col("module"), F.col("file").endswith(".rs"))).select(F.col("file").alias("src"), F.col("module").alias("dst")).distinct()


def coupled(modules: DataFrame, least: int = 0, sort: bool = False) -> DataFrame:
    """Modules (module, fan_out, fan_in, instability) of at least so many edges, most coupled first if asked for."""
    total = F.col("fan_in") + F.col("fan_out")
    kept = modules.filter(total >= least)
    return kept.orderBy(total.desc(), "module") if sort else kept


def dot_graph(edges: DataFrame) -> DataFrame:
    """(part, ord, value): lines of a graph file of edges (src, dst), modules by the last part of their names; in the
    order of part and value they are the file."""
    short = lambda c: F.substring_index(c, "::", -1)
    body = edges.select(F.lit(1).alias("part"), F.concat(F.lit('  "'), short("src"), F.lit('" -> "'), short("dst"), F.lit('";')).alias("value"))
    spark = edges.sparkSession
    frame = [(0, 0, "digraph coupling {"), (0, 1, "  rankdir=LR;"), (0, 2, "  node [shape=box, style=filled, fillcolor=lightblue];"), (0, 3, ""), (2, 0, ""), (2, 1, "}")]
    return spark.createDataFrame(frame, "part int, ord int, value string").unionByName(body.select("part", F.lit(0).alias("ord"), "value"))
