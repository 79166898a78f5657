"""Further registered queries: parsing, Halstead, graphs, life cycle, sinks and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, halstead, lifecycle, parse
from ..sources import corpus, sinks
from ..streaming import watch
from .catalog import CHECKS, CODE, check_table, code_lines, read, register


@register("python_and_brace_functions")
def python_and_brace_functions(spark, sf_dir):
    return parse.functions(corpus.with_language(corpus.code(spark, sf_dir)))


def quoted(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


TOKEN = halstead.TOKEN.replace("'", "''")


@register("halstead", rf"""{CODE}, t AS (SELECT path AS file, unnest(regexp_extract_all(CASE WHEN contains(text, '//') THEN regexp_extract(text, '^(.*?)//', 1) ELSE regexp_extract(text, '^([^#]*)', 1) END, '{TOKEN}', 1)) AS t FROM lines),
    k AS (SELECT file, CASE WHEN regexp_matches(t, '^["'']') THEN 'operand' WHEN regexp_matches(t, '^[\p{{L}}\p{{N}}_]') AND t NOT IN {quoted(halstead.KEYWORDS)} THEN 'operand' ELSE 'operator' END AS kind,
          CASE WHEN regexp_matches(t, '^["'']') THEN '__literal__' ELSE t END AS name FROM t),
    n AS (SELECT file, kind, name, count(*) AS n FROM k GROUP BY 1, 2, 3),
    s AS (SELECT file, count(*) FILTER (kind = 'operator') AS n1, count(*) FILTER (kind = 'operand') AS n2, coalesce(sum(n) FILTER (kind = 'operator'), 0)::BIGINT AS total1, coalesce(sum(n) FILTER (kind = 'operand'), 0)::BIGINT AS total2 FROM n GROUP BY file),
    v AS (SELECT *, round((total1 + total2) * log2(n1 + n2), 6) AS volume, round(CASE WHEN n2 > 0 THEN n1 / 2 * total2 / n2 ELSE 0.0 END, 6) AS difficulty FROM s)
    SELECT *, round(volume / 3000, 6) AS bugs, round(difficulty * volume / 18, 6) AS time FROM v""")
def halstead_by_file(spark, sf_dir):
    return halstead.halstead(code_lines(spark, sf_dir))


@register("transitive_callers", """WITH RECURSIVE calls AS (SELECT DISTINCT 'n' || l_suppkey AS caller, 'n' || (l_suppkey // (2 + l_linenumber % 2)) AS callee FROM lineitem),
    up AS (SELECT 'n1' AS name UNION SELECT calls.caller FROM calls JOIN up ON calls.callee = up.name) SELECT name FROM up""")
def transitive_callers(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    name = lambda c: F.concat(F.lit("n"), c.cast("long").cast("string"))
    calls = l.select(name(F.col("l_suppkey")).alias("caller"), name(F.floor(F.col("l_suppkey") / (2 + F.col("l_linenumber") % 2))).alias("callee")).distinct()
    return graphs.transitive_callers(calls, spark.sql("select 'n1' as name")).select("name")


TOKENS = graphs.TOKENS


@register("duplicate_groups", f"""WITH RECURSIVE k AS (SELECT p_partkey AS ord, list_sort(list_distinct([({list(TOKENS)!r})[1 + (p_partkey * j) % (p_size % 13 + 1)] FOR j IN range(1, 9)])) AS s FROM part),
    d AS (SELECT s, min(ord) AS first FROM k GROUP BY s), o AS (SELECT *, row_number() OVER (ORDER BY first) AS n FROM d),
    g AS (SELECT 0::BIGINT AS n, []::STRUCT(seed BIGINT, s VARCHAR[])[] AS seeds, NULL::VARCHAR[] AS s, NULL::BIGINT AS grp
      UNION ALL SELECT o.n, CASE WHEN len(list_filter(g.seeds, lambda x: len(list_intersect(x.s, o.s)) / len(list_distinct(x.s || o.s)) >= 0.7)) > 0 THEN g.seeds ELSE list_append(g.seeds, {{'seed': o.first, 's': o.s}}) END, o.s,
        coalesce(list_filter(g.seeds, lambda x: len(list_intersect(x.s, o.s)) / len(list_distinct(x.s || o.s)) >= 0.7)[1].seed, o.first) FROM g JOIN o ON o.n = g.n + 1)
    SELECT k.ord, g.grp AS "group" FROM k JOIN g ON g.s = k.s""")
def duplicate_groups(spark, sf_dir):
    table = F.array(*[F.lit(t) for t in TOKENS])
    p = read(spark, sf_dir, "part")
    picked = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.element_at(table, (F.pmod(F.col("p_partkey") * j, F.col("p_size") % 13 + 1) + 1).cast("int")))
    return graphs.duplicate_groups(p.select(F.col("p_partkey").alias("ord"), picked.alias("tokens")))


#: Events of lower values are in the baseline, those of higher values are current, and those between are both.
BASELINE = "SELECT DISTINCT event_type || ':' || user_id || ':' || (event_id % 7) AS finding_id FROM events WHERE value {}"
WAS, IS = "< 60", ">= 40"


@register("baseline_difference", f"""WITH b AS ({BASELINE.format(WAS)}), c AS ({BASELINE.format(IS)})
    SELECT finding_id, CASE WHEN b.finding_id IS NULL THEN 'new' WHEN c.finding_id IS NULL THEN 'resolved' ELSE 'unchanged' END AS status FROM b FULL JOIN c USING (finding_id)""")
def baseline_difference(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = lambda side: e.filter(f"value {side}").select(F.col("event_type").alias("rule_id"), F.col("user_id").cast("string").alias("file"), (F.col("event_id") % 7).alias("line"))
    return lifecycle.baseline_difference(rows(WAS), rows(IS))


@register("remediation", f"""WITH log AS (SELECT finding_id, CASE WHEN length(finding_id) % 2 = 0 THEN 'open' ELSE 'closed' END AS status FROM ({BASELINE.format(WAS)})), c AS ({BASELINE.format(IS)})
    SELECT finding_id, CASE WHEN status = 'open' AND finding_id NOT IN (SELECT finding_id FROM c) THEN 'closed' ELSE status END AS status FROM log
    UNION ALL SELECT finding_id, 'open' FROM c WHERE finding_id NOT IN (SELECT finding_id FROM log)""")
def remediation(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    ids = lambda side: e.filter(f"value {side}").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("finding_id")).distinct()
    return lifecycle.remediate(ids(WAS).withColumn("status", F.when(F.length("finding_id") % 2 == 0, "open").otherwise("closed")), ids(IS))


@register("margin_risks", f"""WITH {CHECKS}, s AS (SELECT run, name, passed, skipped, 80.0 + length(name) + length(run) AS score, 100.0 AS threshold FROM checks),
    m AS (SELECT DISTINCT run, name, round(greatest(0, least(100, CASE WHEN name IN ('doc_coverage', 'doccov', 'propcov', 'typecov') THEN (score - threshold) / threshold * 100 ELSE (threshold - score) / threshold * 100 END)), 6)::DOUBLE AS margin FROM s WHERE passed)
    SELECT run, name, margin FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY margin, name) AS n FROM m WHERE margin < 25) WHERE n <= 3""")
def margin_risks(spark, sf_dir):
    checks = check_table(spark, sf_dir).filter("passed").select("run", "name", "passed").distinct()
    scored = checks.withColumn("score", F.lit(80.0) + F.length("name") + F.length("run")).withColumn("threshold", F.lit(100.0))
    return lifecycle.margin_risks(scored, ["run"])


@register("vulnerability_gate", """WITH v AS (SELECT p_brand, ['critical', 'high', 'medium', 'low'][1 + p_size % 4] AS severity FROM part),
    c AS (SELECT p_brand, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM v GROUP BY 1)
    SELECT *, critical <= 40 AND high <= 40 AS passed FROM c""")
def vulnerability_gate(spark, sf_dir):
    levels = F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")])
    v = read(spark, sf_dir, "part").select("p_brand", F.element_at(levels, F.col("p_size") % 4 + 1).alias("severity"))
    return lifecycle.vulnerability_gate(v, ["p_brand"], 40, 40)


@register("outdated_packages", "SELECT p_partkey, (p_size % 4) || '.1.0' AS version, (p_size % 3) || '.0' AS latest FROM part WHERE p_size % 3 > p_size % 4")
def outdated_packages(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return lifecycle.outdated(p.select("p_partkey", F.concat((F.col("p_size") % 4).cast("string"), F.lit(".1.0")).alias("version"), F.concat((F.col("p_size") % 3).cast("string"), F.lit(".0")).alias("latest")))


@register("dot_edges", """SELECT DISTINCT '  "m' || l_suppkey % 17 || '" -> "m' || l_partkey % 13 || '";' AS value FROM lineitem""")
def dot_edges(spark, sf_dir):
    m = lambda c, k: F.concat(F.lit("m"), (F.col(c) % k).cast("string"))
    return sinks.dot_edges(read(spark, sf_dir, "lineitem").select(m("l_suppkey", 17).alias("src"), m("l_partkey", 13).alias("dst")))


@register("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    w = watch.windowed_counts(read(spark, sf_dir, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
