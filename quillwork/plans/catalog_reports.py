"""Registered queries over the events of a run, run history and HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import reports
from ..streaming import watch
from .catalog import read, register

RUN_FINDINGS = "f AS (SELECT 'c' || p_size % 3 AS c, p_partkey AS k, p_size AS s FROM part)"
#: Checks of a run, c9 without its tool.
RUN_CHECKS = (("c0", True), ("c1", True), ("c2", True), ("c9", False))


@register("ordered_run_events", f"""WITH {RUN_FINDINGS}, r AS (SELECT *, row_number() OVER (ORDER BY c) AS ord FROM (VALUES {', '.join(f"('{c}', {str(a).lower()})" for c, a in RUN_CHECKS)}) v(c, available)),
    n AS (SELECT r.c, r.ord, r.available, count(f.k) AS n FROM r LEFT JOIN f USING (c) GROUP BY ALL)
    SELECT ord::INT AS ord, 0 AS step, 'finding' AS kind, c AS "check", 'x' || k AS file, s AS line, '{{"file":"x' || k || '","line":' || s || ',"rule_id":"R","severity":"low"}}' AS payload FROM f JOIN r USING (c)
    UNION ALL SELECT ord, 1, 'rule_complete', c, NULL, NULL, '{{"findings":' || n || ',"available":' || available || '}}' FROM n
    UNION ALL SELECT ord, 2, 'progress', c, NULL, NULL, '{{"completed":' || ord || ',"total":' || (SELECT count(*) FROM r) || '}}' FROM n
    UNION ALL SELECT (SELECT count(*) + 1 FROM r), 3, 'end', NULL, NULL, NULL, '{{"checks":' || (SELECT count(*) FROM r) || ',"findings":' || (SELECT count(*) FROM f) || '}}'""")
def ordered_run_events(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    found = p.select(F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("check"), F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_size").alias("line"), F.lit("R").alias("rule_id"), F.lit("low").alias("severity"))
    return watch.ordered_events(found, spark.createDataFrame(list(RUN_CHECKS), "check string, available boolean"))


RUNS = "runs AS (SELECT 'p' || user_id % 60 AS project, event_id AS ts, 1 + event_id % 4 AS passed, CASE WHEN value > 70 THEN 1 ELSE 0 END AS failed FROM events)"
LAST = 17
HISTORY = f"""{RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC) AS back FROM runs),
    h AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY back DESC) - 1 AS n, CASE WHEN failed > 0 THEN 0 ELSE 100 END AS score FROM l WHERE back <= {LAST})"""


def run_history(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 60).cast("string")).alias("project"), F.col("event_id").alias("ts"), (1 + F.col("event_id") % 4).alias("passed"), F.when(F.col("value") > 70, 1).otherwise(0).alias("failed"))


@register("health_history", f"WITH {HISTORY} SELECT project, n, score FROM h")
def health_history(spark, sf_dir):
    return reports.health_history(run_history(spark, sf_dir), LAST)


SPARK = f"""s AS (SELECT project, min(score) AS low, greatest(max(score), 1) AS high, count(*) AS many FROM h GROUP BY project),
    q AS (SELECT project, n, many, printf('%.1f', n * 120.0::DOUBLE / greatest(many - 1, 1)) AS x, printf('%.1f', 36.0::DOUBLE - (score - low)::DOUBLE / greatest(high - low, 1) * 32.0::DOUBLE) AS y FROM h JOIN s USING (project)),
    svg AS (SELECT project, CASE WHEN any_value(many) < 2 THEN '' ELSE '<svg viewBox="0 0 120 40" width="120" height="40" style="display:block"><line x1="0" y1="20" x2="120" y2="20" stroke="#e2e8f0" stroke-width="1" stroke-dasharray="3,3"/><polyline points="'
        || string_agg(x || ',' || y, ' ' ORDER BY n) || '" fill="none" stroke="#6366f1" stroke-width="2" stroke-linecap="round" stroke-linejoin="round"/>' || string_agg('<circle cx="' || x || '" cy="' || y || '" r="2.5" fill="#6366f1"/>', '' ORDER BY n) || '</svg>' END AS svg FROM q GROUP BY project)"""


@register("health_sparklines", f"WITH {HISTORY}, {SPARK} SELECT project, svg FROM svg")
def health_sparklines(spark, sf_dir):
    return reports.sparklines(reports.health_history(run_history(spark, sf_dir), LAST))


@register("html_report", f"""WITH {RUN_FINDINGS}, runs AS (SELECT 'a&b' AS project, event_id AS ts, CASE WHEN value > 70 THEN 1 ELSE 0 END AS failed FROM events), {HISTORY.removeprefix(RUNS + ', ')}, {SPARK}
    SELECT 0 AS part, 0::BIGINT AS ord, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>a&amp;b</title></head><body>' || chr(10) || '<h1>a&amp;b</h1>' || chr(10) || '<p>3 of 4 checks passed</p>' AS value
    UNION ALL SELECT 1, 0, svg FROM svg UNION ALL SELECT 2, 0, '<table class="checks">'
    UNION ALL SELECT 3, 0, '<tr><td>' || c || '</td>' || CASE WHEN ok THEN '<td class="pass">PASS</td>' ELSE '<td class="fail">FAIL</td>' END || '<td>m&lt;' || c || '</td></tr>' FROM (VALUES {', '.join(f"('{c}', {str(a).lower()})" for c, a in RUN_CHECKS)}) v(c, ok)
    UNION ALL SELECT 4, 0, '</table>' || chr(10) || '<table class="findings">'
    UNION ALL SELECT 5, k, '<tr><td>low</td><td>' || c || '</td><td>x' || k || '</td><td>' || s || '</td><td>f&gt;' || k || '</td></tr>' FROM f
    UNION ALL SELECT 6, 0, '</table>' || chr(10) || '</body></html>'""")
def html_report(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    found = p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("check"), F.concat(F.lit("x"), k).alias("file"), F.col("p_size").alias("line"), F.lit("low").alias("severity"), F.concat(F.lit("f>"), k).alias("message"))
    checks = spark.createDataFrame([(c, ok, f"m<{c}") for c, ok in RUN_CHECKS], "check string, passed boolean, message string")
    history = reports.health_history(run_history(spark, sf_dir).withColumn("project", F.lit("a&b")), LAST)
    return reports.html_report("a&b", found, checks, history)
