"""From findings and check results to rollups, scores, grades, opinions and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Check names by category, and the weights of categories.
CATEGORIES = {
    "Security": ("secrets", "sast", "crypto", "taint", "vulnscan", "access-control", "errhandle"),
    "Compliance": ("licenses", "sbom", "supply-chain", "outdated"),
    "Quality": ("crap", "complexity", "deadcode", "coupling", "dupfind", "duplication", "riskmap", "halstead", "cohesion", "fuzz", "propcov"),
    "Hygiene": ("debt", "comments", "linelen", "doccov", "doc_coverage", "typecov"),
    "Operations": ("observability", "test-quality", "design-docs", "debuggability"),
}
CATEGORY_WEIGHTS = {"Security": 5, "Compliance": 3, "Quality": 2, "Hygiene": 1, "Operations": 1}
GATE_KILLERS = ("secrets", "vulnscan", "sast", "taint")
HEALTH_HEAVY, HEALTH_MIDDLE = ("secrets", "vulnscan", "taint", "errhandle", "sast", "crypto"), ("licenses", "sbom")


def severity_weight(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity.isin("high", "error"), 3).when(severity.isin("medium", "warning"), 2).when(severity == "low", 1).otherwise(0)


def file_rollup(findings: DataFrame) -> DataFrame:
    """(file, n_findings, score, critical, high, medium, low): one pass, summed before the shuffle."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    return findings.groupBy("file").agg(F.count(F.lit(1)).alias("n_findings"), F.sum(severity_weight(F.col("severity"))).alias("score"), *map(n, ("critical", "high", "medium", "low")))


def file_summary(findings: DataFrame) -> DataFrame:
    """(file, n_findings, score, severities map): findings of a file counted by severity, whatever severities there are."""
    counts = findings.groupBy("file", "severity").agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n"))))
    return counts.groupBy("file").agg(F.sum("n").alias("n_findings"), F.sum(F.col("n") * severity_weight(F.col("severity"))).alias("score"), entries.alias("severities"))


def worst_files(summary: DataFrame, count: int = 20) -> DataFrame:
    """The files (file, n_findings, score) of the highest score, then of most findings."""
    return summary.orderBy(F.desc("score"), F.desc("n_findings"), "file").limit(count)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high", "error"), "error").when(severity.isin("low", "note"), "note").otherwise("warning")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 65, "C").when(score >= 50, "D").otherwise("F")


def health(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(..., score, grade) of checks (name, passed): weights 3, 2 and 1. No checks: 100."""
    w = F.when(F.col("name").isin(*HEALTH_HEAVY), 3).when(F.col("name").isin(*HEALTH_MIDDLE), 2).otherwise(1)
    total = checks.groupBy(*(by or [])).agg(F.sum(w).alias("all"), F.sum(F.when(F.col("passed"), w).otherwise(0)).alias("ok"))
    score = F.coalesce(F.floor(F.lit(100) * F.col("ok") / F.nullif(F.col("all"), F.lit(0))), F.lit(100)).cast("int")
    return total.select(*(by or []), score.alias("score")).withColumn("grade", grade(F.col("score")))


def category(name: Column) -> Column:
    chain = F
    for c, names in CATEGORIES.items():
        chain = chain.when(name.isin(*names), c)
    return chain


def audit(checks: DataFrame, by: list[str]) -> DataFrame:
    """(..., score, grade, opinion) of checks (name, passed, skipped): pass rates by category, then their
    weighted mean over the categories that are there."""
    weight = F.create_map(*[F.lit(x) for kv in CATEGORY_WEIGHTS.items() for x in kv])
    named = checks.withColumn("category", category(F.col("name")))
    rates = named.filter("category is not null").groupBy(*by, "category").agg((F.sum(F.when(F.col("passed"), 1).otherwise(0)) * 100.0 / F.count(F.lit(1))).alias("rate")).withColumn("w", weight[F.col("category")])
    scores = rates.groupBy(*by).agg(F.floor(F.round(F.sum(F.col("rate") * F.col("w")) / F.sum("w"), 6)).cast("int").alias("score"))
    killers = F.count_distinct(F.when(F.col("name").isin(*GATE_KILLERS) & F.col("passed"), F.col("name")))
    gates = checks.groupBy(*by).agg(F.sum(F.when(F.col("skipped"), 1).otherwise(0)).alias("skips"), killers.alias("alive"), F.count(F.when(F.col("name").isin(*GATE_KILLERS) & ~F.col("passed"), 1)).alias("dead"))
    opinion = F.when(F.col("skips") >= 5, "DISCLAIMER").when((F.col("alive") < len(GATE_KILLERS)) | (F.col("dead") > 0), "ADVERSE").when(F.col("score") >= 80, "UNQUALIFIED").otherwise("QUALIFIED")
    joined = gates.join(scores, by, "left").withColumn("score", F.coalesce("score", F.lit(100)))
    return joined.select(*by, "score", grade(F.col("score")).alias("grade"), opinion.alias("opinion"))


def difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, status): checks (key, passed) before and after; regressed, improved, same, new or gone."""
    b, a = before.withColumnRenamed("passed", "was"), after.withColumnRenamed("passed", "now")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") & ~F.col("now"), "regressed").when(~F.col("was") & F.col("now"), "improved").otherwise("same")
    return b.join(a, key, "full").select(*key, status.alias("status"))


def without_exceptions(findings: DataFrame, exceptions: DataFrame) -> DataFrame:
    return findings.join(exceptions.filter("approved").select("rule_id", "file"), ["rule_id", "file"], "left_anti")


def finding_id() -> Column:
    return F.concat_ws(":", "rule_id", "file", F.coalesce("line", F.lit(0)).cast("string"))


def latest(runs: DataFrame, count: int) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(count)


def with_skipped(checks: DataFrame) -> DataFrame:
    """(..., available, passed, score, message) of checks with an error text: one whose tool isn't there passes,
    without a score, and says so."""
    skipped = F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("Skipped: "), "error")).otherwise("Skipped: tool unavailable or produced no JSON output")
    return checks.withColumn("passed", ~F.col("available") | F.col("passed")).withColumn("score", F.when(F.col("available"), F.col("score"))).withColumn("message", F.when(F.col("available"), F.col("message")).otherwise(skipped)).drop("error")
