"""Registered queries over scalar functions, gates, fixes, rule packs, events and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, graphs, metrics, parse, rule_tables, scans, scoring
from ..sources import corpus, history, reports
from ..streaming import watch
from .catalog import CODE, CODE_FILES, DOCSTRING, LINES, LIVE, among, cases, code_lines, crap, function_table, parts, read, register, risk, text
from .catalog_flows import tree
from .catalog_sources import CRYPTO_SQL, report_checks, report_findings

NAMES = ("plain name", "日本語の長い名前", "caf" + chr(233) + " au lait", "ok " + chr(0x1F642) + " done", "")
SHORT = 6


def sql_list(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def one_of(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


LEFT = ("plain…", "日本…", "café …", "ok " + chr(0x1F642) + "…", "")
RIGHT = ("… name", "…名前", "… lait", "… done", "")


@register("truncated_names", f"SELECT p_partkey, ({sql_list(LEFT)})[1 + p_partkey % 5] AS left_kept, ({sql_list(RIGHT)})[1 + p_partkey % 5] AS right_kept, ([10, 16, 12, 10, 0])[1 + p_partkey % 5] AS width FROM part")
def truncated_names(spark, sf_dir):
    n = one_of(NAMES, F.col("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", T.truncate_left(n, SHORT).alias("left_kept"), T.truncate(n, SHORT).alias("right_kept"), T.width(n).alias("width"))


RULES = ("observability-raw-log", "contextless-unwrap", "Test-Quality", "design_docs", "doccov-low", "errhandle-unwrap", "SAST-1")
PHASES = ("§7 Support / §4.5 Tracing", "§6.6 Debug / §4.5 Tracing", "§6 Test", "§3 Design", "§3 Design / §4 Code", "§7 Support / §4 Code", "§4 Code")


@register("rule_phases", f"SELECT ({sql_list(RULES)})[1 + p_partkey % 7] AS rule_id, ({sql_list(PHASES)})[1 + p_partkey % 7] AS phase, count(*) AS n FROM part GROUP BY 1, 2")
def rule_phases(spark, sf_dir):
    rules = read(spark, sf_dir, "part").select(one_of(RULES, F.col("p_partkey")).alias("rule_id"))
    return rules.groupBy("rule_id", T.phase(F.col("rule_id")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@register("severity_scores", "SELECT p_partkey, CASE p_size % 6 WHEN 5 THEN NULL ELSE p_size % 6 END::INT AS score FROM part")
def severity_scores(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.severity_score(one_of(("Info", "low", "MEDIUM", "high", "critical", "odd"), F.col("p_size"))).alias("score"))


@register("event_properties", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events")
def event_properties(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.json_value(F.col("props"), "$.k", "none").alias("k"), T.json_value(F.col("props"), "$.absent", "none").alias("absent"))


@register("first_lines", f"WITH {CODE_FILES}, {LINES} SELECT path, coalesce(min(line) FILTER (contains(text, 'Md5::')), 1)::INT AS line FROM lines GROUP BY 1")
def first_lines(spark, sf_dir):
    return corpus.code(spark, sf_dir).select("path", T.first_line_with(F.col("content"), F.lit("Md5::")).alias("line"))


@register("marker_counts", f"WITH {CODE_FILES} SELECT path, ((length(content) - length(replace(content, 'value', ''))) / 5)::INT AS n FROM files")
def marker_counts(spark, sf_dir):
    return corpus.code(spark, sf_dir).select("path", T.occurrences(F.col("content"), F.lit("value")).alias("n"))


@register("named_imports", f"{CODE} SELECT path AS file, line, CASE WHEN starts_with(trimmed, 'use ') THEN 'tracing::info' END AS target, CASE WHEN contains(text, '\"') THEN regexp_extract(text, '\"([^\"]*)\"', 1) END AS literal FROM lines WHERE starts_with(trimmed, 'use ') OR regexp_matches(text, '\"[^\"]*\"')")
def named_imports(spark, sf_dir):
    found = code_lines(spark, sf_dir).select(F.col("path").alias("file"), "line", T.keyword_import(F.col("text"), "use ").alias("target"), T.quoted(F.col("text")).alias("literal"))
    return found.filter("target is not null or literal is not null")


@register("event_runs", """WITH r AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, count(*)::INT AS runs FROM r WHERE before IS DISTINCT FROM event_type GROUP BY 1""")
def event_runs(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    by_user = read(spark, sf_dir, "events").groupBy("user_id").agg(ordered.alias("e"))
    return by_user.select("user_id", F.size(T.without_repeats(F.transform("e", lambda x: x["event_type"]))).alias("runs"))


# --- gates --------------------------------------------------------------------------------------


@register("crap_gate", """WITH fns AS (SELECT 'fn' || l_orderkey || '_' || l_linenumber AS name, l_quantity::BIGINT % 13 AS c FROM lineitem), cov AS (SELECT 'fn' || o_orderkey || '_1' AS name, max(o_orderkey % 3) AS hits FROM orders GROUP BY 1),
    s AS (SELECT c::DOUBLE * c * CASE WHEN coalesce(hits, 0) > 0 THEN 0 ELSE 1 END + c AS crap FROM fns LEFT JOIN cov USING (name)) SELECT round(avg(crap), 6) AS average, round(avg(crap), 6) <= 30 AS passed FROM s""")
def crap_gate(spark, sf_dir):
    return metrics.crap_gate(crap(spark, sf_dir))


@register("complexity_gate", "SELECT count(*) FILTER (l_quantity::BIGINT % 13 >= 10) AS violations, count(*) FILTER (l_quantity::BIGINT % 13 >= 10) <= 0 AS passed FROM lineitem")
def complexity_gate(spark, sf_dir):
    return metrics.complexity_gate(function_table(spark, sf_dir))


@register("unsafe_blocks", f"{CODE} SELECT path AS file, count(*) AS unsafe FROM lines WHERE ext = 'rs' AND contains(text, 'unsafe {{') GROUP BY 1")
def unsafe_blocks(spark, sf_dir):
    return metrics.unsafe_blocks(code_lines(spark, sf_dir))


@register("risk_with_unsafe", """WITH fns AS (SELECT 'f' || l_suppkey AS file, sum(l_quantity::BIGINT % 13)::BIGINT AS complexity FROM lineitem GROUP BY 1), churn AS (SELECT 'f' || s_suppkey AS file, s_suppkey % 40 AS commits, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 7 ELSE 0 END AS unsafe FROM supplier),
    r AS (SELECT file, commits, complexity, least(100, floor(sqrt(commits) * (complexity + 2 * unsafe) / 20))::INT AS risk FROM churn JOIN fns USING (file))
    SELECT *, CASE WHEN risk >= 70 THEN 'DANGER' WHEN risk >= 40 THEN 'HIGH' WHEN risk >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")
def risk_with_unsafe(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file"), (F.col("s_suppkey") % 40).alias("commits"), "s_suppkey")
    return metrics.risk(s.select("file", "commits"), function_table(spark, sf_dir), s.filter("s_suppkey % 3 = 0").select("file", (F.col("s_suppkey") % 7).alias("unsafe")))


@register("danger_zone", """WITH fns AS (SELECT 'f' || l_suppkey AS file, sum(l_quantity::BIGINT % 13) AS complexity FROM lineitem GROUP BY 1) SELECT file FROM fns JOIN (SELECT 'f' || s_suppkey AS file, s_suppkey % 40 AS commits FROM supplier) USING (file) WHERE commits > 5 AND complexity > 20""")
def danger_zone(spark, sf_dir):
    return metrics.danger_zone(risk(spark, sf_dir))


# --- packs, registry ----------------------------------------------------------------------------

PACK = ((0, "P-1", "style", "low", "let ", "out"), (1, "P-2", "style", "high", "let ", ""), (2, "P-3", "log", "medium", "console", ""))


@register("rule_pack_findings", f"""{CODE}, f AS (SELECT path AS file, line, CASE WHEN contains(text, 'let ') AND contains(text, 'out') THEN 'P-1' WHEN contains(text, 'let ') THEN 'P-2' WHEN contains(text, 'console') THEN 'P-3' END AS rule_id FROM lines)
    SELECT *, CASE rule_id WHEN 'P-3' THEN 'log' ELSE 'style' END AS category, CASE rule_id WHEN 'P-1' THEN 'low' WHEN 'P-2' THEN 'high' ELSE 'medium' END AS severity FROM f WHERE rule_id IS NOT NULL""")
def rule_pack_findings(spark, sf_dir):
    pack = spark.createDataFrame(list(PACK), "ord int, rule_id string, category string, severity string, pattern string, also string")
    return checks.pack_findings(code_lines(spark, sf_dir), pack)


def registry() -> checks.Registry:
    made = checks.Registry()
    made.check("crypto")(lambda c: scans.crypto(c.table("lines")))
    made.check("churn")(lambda c: c.table("history"))
    return made


@register("registered_checks", f"""{CODE}, f AS (SELECT count(*) AS n FROM lines WHERE ext IN ('rs', 'py', 'js', 'go', 'java') AND contains(text, 'Md5::') AND NOT regexp_matches(trimmed, '^(//|#|\\*)'))
    SELECT 'crypto' AS "check", true AS available, n AS findings FROM f UNION ALL SELECT 'churn', false, 0""")
def registered_checks(spark, sf_dir):
    found, states = checks.run_checks(registry(), checks.Context(spark, {"lines": lambda: code_lines(spark, sf_dir)}))
    counts = found.groupBy("check").agg(F.count(F.lit(1)).alias("findings"))
    return states.join(counts, "check", "left").select("check", "available", F.coalesce("findings", F.lit(0)).alias("findings"))


@register("project_fingerprints", """WITH f AS (SELECT p_size AS project, sha256(p_name || chr(0) || sha256(p_type)) AS h FROM part) SELECT project, sha256('v1' || string_agg(h, '' ORDER BY h)) AS fingerprint FROM f GROUP BY 1""")
def project_fingerprints(spark, sf_dir):
    return history.fingerprints(read(spark, sf_dir, "part").select(F.col("p_size").alias("project"), F.col("p_name").alias("path"), F.col("p_type").alias("content")), "v1")


SEVERITIES = ("high", "low", "medium", "odd")


def severities(spark, sf_dir):
    s = F.col("p_size")
    return read(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 300).cast("string")).alias("file"), one_of(SEVERITIES, s).alias("severity"))


SUMMARY = f"""s AS (SELECT 'f' || p_partkey % 300 AS file, ({sql_list(SEVERITIES)})[1 + p_size % 4] AS severity FROM part), n AS (SELECT file, severity, count(*) AS n FROM s GROUP BY 1, 2),
    f AS (SELECT file, sum(n)::BIGINT AS n_findings, sum(n * CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)::BIGINT AS score, '{{' || string_agg('"' || severity || '":' || n, ',' ORDER BY severity) || '}}' AS severities FROM n GROUP BY 1)"""


@register("file_summaries", f"WITH {SUMMARY} SELECT * FROM f")
def file_summaries(spark, sf_dir):
    return scoring.file_summary(severities(spark, sf_dir)).withColumn("severities", F.to_json("severities"))


@register("worst_files", f"WITH {SUMMARY} SELECT file, n_findings, score FROM f ORDER BY score DESC, n_findings DESC, file LIMIT 20")
def worst_files(spark, sf_dir):
    return scoring.worst_files(scoring.file_summary(severities(spark, sf_dir)).drop("severities"))


@register("confident_findings", f"{CODE}{LIVE}, found AS ({cases([r for r in rule_tables.SAST if r.confidence == 'high'])} FROM live WHERE ext IN {among(scans.SAST_EXTENSIONS)} AND NOT regexp_matches(trimmed, '^(//|#|--|<!--|;|%)') AND NOT {DOCSTRING}) SELECT * FROM found WHERE rule_id IS NOT NULL")
def confident_findings(spark, sf_dir):
    return scans.sast(code_lines(spark, sf_dir), "high")


CALLS = ("fn a() {", "    b(1);", "    // c()", "}", "fn b(x: u32) {", "    let y = a();", "    x.push(&mut c);", "}", "fn c() {", "    abc(2); a::go();", "}")


@register("call_edges", """SELECT 'k' || p_partkey || '.rs' AS file, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['a', 'b', 'c', 'c', 'abc'] ELSE ['a', 'b', 'c', 'c', 'c', 'abc'] END) AS caller, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['b', 'c', 'a', 'abc', 'c'] ELSE ['b', 'c', 'a', 'abc', 'b', 'c'] END) AS callee FROM part""")
def call_edges(spark, sf_dir):
    p = F.col("p_partkey")
    body = F.concat(F.lit("\n".join(CALLS)), F.lit("\nfn abc() {\n}\n"))
    files = parts(spark, sf_dir).select(F.concat(F.lit("k"), p.cast("string"), F.lit(".rs")).alias("path"), F.when(p % 2 == 0, body).otherwise(F.replace(body, F.lit("abc(2);"), F.lit("abc(2); b();"))).alias("content"))
    starts = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("line"), F.lit(z).alias("end_line")) for n, a, z in (("a", 1, 4), ("b", 5, 8), ("c", 9, 11), ("abc", 12, 13))])).alias("f")
    return graphs.call_edges(corpus.lines(files), files.select(F.col("path").alias("file"), starts).select("file", "f.*"))


@register("json_report", f"""WITH {CRYPTO_SQL}, m AS (SELECT min(ord) AS first FROM f)
    SELECT 0 AS part, 0::BIGINT AS ord, '{{"passed":false,"summary":{{"total_checks":3,"failed_checks":2}},"checks":[' AS value
    UNION ALL SELECT 1, 1, '{{"name":"crypto","passed":false,"message":"bad","severity":"high","rule_id":"C","help":"h"}}' UNION ALL SELECT 1, 2, ',{{"name":"debt","passed":true,"message":"fine"}}'
    UNION ALL SELECT 1, 3, ',{{"name":"sast","passed":false,"message":"none found"}}' UNION ALL SELECT 2, 0, '],"findings":[' UNION ALL SELECT 4, 0, ']}}'
    UNION ALL SELECT 3, ord, CASE WHEN ord > first THEN ',' ELSE '' END || '{{"check":"crypto","file":"' || file || '","line":' || line || ',"severity":"' || severity || '","message":"' || message || '","rule_id":"' || rule_id || '","fix_hint":"' || fix_hint || '"}}' FROM f, m""")
def json_report(spark, sf_dir):
    return reports.json_report(report_findings(spark, sf_dir), report_checks(spark))


# --- events -------------------------------------------------------------------------------------


@register("sliding_windows", """WITH s AS (SELECT unnest([date_trunc('hour', ts) + to_minutes(15 * (extract(minute FROM ts)::INT // 15)) - to_minutes(15 * k) FOR k IN range(4)]) AS start FROM events) SELECT start, count(*) AS n FROM s GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    w = watch.sliding_counts(read(spark, sf_dir, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("followed_events", "SELECT a.user_id, a.ts AS at, b.ts AS after FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE")
def followed_events(spark, sf_dir):
    out = watch.followed(read(spark, sf_dir, "events"), read(spark, sf_dir, "events"))
    return out.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), F.col("after").cast("timestamp_ntz").alias("after"))


@register("requested_events", "SELECT event_id, event_type AS rule_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS severity FROM events WHERE value > 50 AND event_type <> (SELECT min(event_type) FROM events)")
def requested_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule_id"), F.when(F.col("value") > 50, "high").otherwise("low").alias("severity"))
    least = e.agg(F.min("rule_id").alias("least"))
    wanted = e.select("rule_id").distinct().join(least, F.col("rule_id") != F.col("least")).select("rule_id")  # one row beside the distinct types
    return watch.filtered(e, ("high", "critical")).join(wanted, "rule_id", "left_semi").select("event_id", "rule_id", "severity")


@register("run_events", """WITH f AS (SELECT 'c' || p_size % 3 AS c, p_partkey AS k, p_size AS s FROM part)
    SELECT 'finding' AS kind, c AS "check", '{"file":"x' || k || '","line":' || s || ',"rule_id":"R","severity":"low"}' AS payload FROM f
    UNION ALL SELECT 'rule_complete', c, '{"findings":' || count(*) || ',"available":true}' FROM f GROUP BY c UNION ALL SELECT 'rule_complete', 'c9', '{"findings":0,"available":false}' UNION ALL SELECT 'end', NULL, '{"checks":4}'""")
def run_events(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    found = p.select(F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("check"), F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_size").alias("line"), F.lit("R").alias("rule_id"), F.lit("low").alias("severity"))
    results = spark.createDataFrame([("c0", True), ("c1", True), ("c2", True), ("c9", False)], "check string, available boolean")
    return watch.check_events(found, results)


# --- parsed structure, tested by fixtures ---------------------------------------------------------


@register("duplicate_functions")
def duplicate_functions(spark, sf_dir):
    prints = parse.fingerprints(corpus.with_language(tree(spark, sf_dir)))
    numbered = prints.withColumn("ord", F.xxhash64("path", "line", "name"))
    return graphs.duplicate_groups(numbered.select("ord", "tokens"), min_tokens=2).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@register("struct_cohesion", "SELECT 3 AS methods, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS components, count(*) AS n FROM part GROUP BY 1, 2")
def struct_cohesion(spark, sf_dir):
    p = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("pub struct S"), p, F.lit(" {\n    pub a: u32,\n    b: u32,\n}\n\nimpl S"), p, F.lit(" {\n    fn one(&self) -> u32 { self.a }\n    pub fn two(&self) -> u32 { self."), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b"), F.lit(" }\n    fn three(&self) {}\n}\n"))
    files = parts(spark, sf_dir).select(F.concat(F.lit("s"), p, F.lit(".rs")).alias("path"), body.alias("content"))
    return graphs.lcom4(parse.struct_methods(files)).groupBy("methods", "components").agg(F.count(F.lit(1)).alias("n"))
