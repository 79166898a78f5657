"""Baselines, remediation, margins, vulnerabilities and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import finding_id

INVERTED = ("doc_coverage", "doccov", "propcov", "typecov")


def baseline_difference(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(finding_id, status) of findings (rule_id, file, line): new, resolved or unchanged."""
    ids = lambda df, flag: df.select(finding_id().alias("finding_id")).distinct().withColumn(flag, F.lit(True))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged")
    return ids(baseline, "was").join(ids(current, "now"), "finding_id", "full").select("finding_id", status.alias("status"))


def remediate(log: DataFrame, current: DataFrame) -> DataFrame:
    """The remediation log (finding_id, status) after a run: open rows whose finding is gone close, and
    findings (finding_id) that the log lacks are added as open."""
    there = current.select("finding_id").distinct().withColumn("there", F.lit(True))
    old = log.join(there, "finding_id", "left").withColumn("status", F.when((F.col("status") == "open") & F.col("there").isNull(), "closed").otherwise(F.col("status"))).drop("there")
    fresh = there.join(log, "finding_id", "left_anti").select("finding_id", F.lit("open").alias("status"))
    return old.select("finding_id", "status").unionByName(fresh)


def margin_risks(checks: DataFrame, by: list[str], count: int = 3, below: float = 25.0) -> DataFrame:
    """(..., name, margin): passed checks (name, passed, score, threshold) closest to failing."""
    s, t = F.col("score"), F.col("threshold")
    raw = F.when(F.col("name").isin(*INVERTED), (s - t) / t).otherwise((t - s) / t) * 100
    near = checks.filter(F.col("passed") & s.isNotNull() & (t != 0)).withColumn("margin", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 6)).filter(F.col("margin") < below)
    w = Window.partitionBy(*by).orderBy("margin", "name")
    return near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= count).select(*by, "name", "margin")


def vulnerability_gate(found: DataFrame, by: list[str], most_critical: int = 0, most_high: int = 0) -> DataFrame:
    n = lambda s: F.count(F.when(F.lower("severity") == s, 1)).alias(s)
    counts = found.groupBy(*by).agg(*map(n, ("critical", "high", "medium", "low")))
    return counts.withColumn("passed", (F.col("critical") <= most_critical) & (F.col("high") <= most_high))


def outdated(packages: DataFrame) -> DataFrame:
    """Packages (name, version, latest) whose latest major version is higher."""
    major = lambda c: F.expr(f"try_cast(split({c}, '[.]')[0] AS int)")
    return packages.filter(major("latest") > major("version"))


def lost_tools(baseline: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """(..., tool) of tools that succeeded in the baseline and don't now."""
    return baseline.select(*by, "tool").distinct().join(current.select(*by, "tool").distinct(), [*by, "tool"], "left_anti")


def policy_errors(controls: DataFrame, known: DataFrame) -> DataFrame:
    """(id, error) of controls (id, name, tool): no id, no name, or a tool that isn't known (tool)."""
    tools = known.select("tool").distinct().withColumn("known", F.lit(True))
    each = F.array_compact(F.array(
        F.when(F.col("id") == "", "missing id"), F.when(F.col("name") == "", "missing name"), F.when(F.col("known").isNull(), F.concat(F.lit("unknown tool "), "tool")),
    ))
    return controls.join(tools, "tool", "left").select("id", F.explode(each).alias("error"))
