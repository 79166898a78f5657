"""Report sinks. Rows are rendered as text by the executors; writers are Spark's."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import sarif_level


def ndjson(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object a finding (file, line, rule_id, severity)."""
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    body = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("rule_id").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select(F.to_json(body).alias("value"))


def xml_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def junit_cases(findings: DataFrame) -> DataFrame:
    return findings.select(F.concat(F.lit('<testcase name="'), xml_escaped(F.concat_ws(":", "rule_id", "file", "line")), F.lit('"><failure message="'), xml_escaped(F.col("severity")), F.lit('"/></testcase>')).alias("value"))


def dot_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('  "%s" -> "%s";', "src", "dst").alias("value")).distinct()


def markdown_rows(rollup: DataFrame) -> DataFrame:
    return rollup.select(F.format_string("| %s | %d | %d |", "file", "n_findings", "score").alias("value"))


def append_history(runs: DataFrame, path: str) -> None:
    """Runs (ts epoch seconds, ...) appended as JSON lines, a folder a month."""
    runs.withColumn("month", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


SIGNED = ("timestamp", "actor", "command", "scope", "findings_count")


def signed(rows: DataFrame, key: bytes, columns: tuple[str, ...] = ()) -> DataFrame:
    """Audit rows with the HMAC-SHA256 of some of their values joined by bars: those of SIGNED, if they are there.
    The key goes to workers within the function, so that no plan and no event log shows it."""

    @F.pandas_udf("string")
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    named = columns or (SIGNED if set(SIGNED) <= set(rows.columns) else tuple(rows.columns))
    return rows.withColumn("signature", sign(F.concat_ws("|", *[F.col(c).cast("string") for c in named])))


def append_trail(rows: DataFrame, key: bytes, path: str) -> None:
    """Signed audit rows appended as JSON lines."""
    signed(rows, key).write.mode("append").json(path)
