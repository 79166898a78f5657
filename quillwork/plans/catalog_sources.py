"""Registered queries over sources that are parsed: packages, audit reports, history, reports.

Each side makes its own: the queries build files from a table and parse them, the SQL twins say from the
same table what has to come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, lifecycle, metrics, scans, scoring
from ..sources import corpus, history, packages, reports, sinks
from .catalog import CODE, code_lines, read, register



def key():
    return F.col("p_partkey")


def text(c):
    return c.cast("string")


def one_of(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def sql_one_of(values, by):
    return "([" + ", ".join("'" + v + "'" for v in values) + f"])[1 + ({by}) % {len(values)}]"


LICENSES = ("MIT", "Apache-2.0", "GPL-3.0", "MPL-2.0")
#: A folder a part: an npm lock, an npm manifest, requirements, or a cargo lock and manifest.
KIND = "p_partkey % 4"


def project_files(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    folder = F.concat(F.lit("r"), text(key()), F.lit("/"))
    v, lic = text(F.col("p_size")), one_of(LICENSES, key())
    lock = F.concat(F.lit('{"name":"x","packages":{"":{"version":"0"},"node_modules/n'), text(key()), F.lit('":{"version":"'), v, F.lit('","license":"'), lic, F.lit('"},"node_modules/m'), text(key()), F.lit('":{}}}'))
    manifest = F.concat(F.lit('{"dependencies":{"d'), text(key()), F.lit('":"^'), v, F.lit('"},"devDependencies":{"e'), text(key()), F.lit('":"~'), v, F.lit('"}}'))
    req = F.concat(F.lit("# pinned\nPkg"), text(key()), F.lit("=="), v, F.lit("\nlow"), text(key()), F.lit(">="), v, F.lit("\n\nfree"), text(key()), F.lit("\n"))
    cargo = F.concat(F.lit('version = 3\n\n[[package]]\nname = "c'), text(key()), F.lit('"\nversion = "'), v, F.lit('"\nsource = "registry"\n'), F.when(F.col("p_size") % 2 == 0, 'checksum = "ff"\n').otherwise(""), F.lit('\n[[package]]\nname = "o'), text(key()), F.lit('"\nversion = "1"\n'))
    toml = F.concat(F.lit('[package]\nname = "c'), text(key()), F.lit('"\nlicense = "'), lic, F.lit('"\n\n[dependencies]\nname = "no"\n'))
    rows = F.when(key() % 4 == 0, F.array(F.struct(F.lit("package-lock.json").alias("n"), lock.alias("c")), F.struct(F.lit("package.json").alias("n"), F.lit("{}").alias("c"))))
    rows = rows.when(key() % 4 == 1, F.array(F.struct(F.lit("package.json").alias("n"), manifest.alias("c")))).when(key() % 4 == 2, F.array(F.struct(F.lit("requirements.txt").alias("n"), req.alias("c"))))
    rows = rows.otherwise(F.array(F.struct(F.lit("Cargo.lock").alias("n"), cargo.alias("c")), F.struct(F.lit("Cargo.toml").alias("n"), toml.alias("c"))))
    return p.select(folder.alias("folder"), F.explode(rows).alias("f")).select(F.concat("folder", "f.n").alias("path"), F.col("f.c").alias("content"))


LICENSE_SQL = sql_one_of(LICENSES, "p_partkey")
INVENTORY = f"""p AS (SELECT p_partkey AS k, p_size::VARCHAR AS v, {LICENSE_SQL} AS lic FROM part),
    inv AS (SELECT 'npm' AS ecosystem, 'n' || k AS name, v AS version, lic AS license FROM p WHERE k % 4 = 0 UNION ALL SELECT 'npm', 'm' || k, '?', 'NOASSERTION' FROM p WHERE k % 4 = 0
      UNION ALL SELECT 'npm', 'd' || k, v, 'NOASSERTION' FROM p WHERE k % 4 = 1 UNION ALL SELECT 'npm', 'e' || k, v, 'NOASSERTION' FROM p WHERE k % 4 = 1
      UNION ALL SELECT 'pypi', 'Pkg' || k, v, 'NOASSERTION' FROM p WHERE k % 4 = 2 UNION ALL SELECT 'pypi', 'low' || k, '?', 'NOASSERTION' FROM p WHERE k % 4 = 2
      UNION ALL SELECT 'pypi', 'free' || k, '?', 'NOASSERTION' FROM p WHERE k % 4 = 2
      UNION ALL SELECT 'cargo', 'c' || k, v, lic FROM p WHERE k % 4 = 3 UNION ALL SELECT 'cargo', 'o' || k, '1', 'NOASSERTION' FROM p WHERE k % 4 = 3),
    full_inv AS (SELECT *, 'pkg:' || ecosystem || '/' || CASE WHEN ecosystem = 'pypi' THEN lower(name) ELSE name END || '@' || version AS purl FROM inv)"""


@register("package_inventory", f"WITH {INVENTORY} SELECT ecosystem, name, version, license, purl FROM full_inv")
def package_inventory(spark, sf_dir):
    return packages.inventory(project_files(spark, sf_dir))


@register("npm_lock_packages", f"WITH {INVENTORY} SELECT 'r' || substr(name, 2) || '/package-lock.json' AS path, * FROM full_inv WHERE name[1] IN ('n', 'm')")
def npm_lock_packages(spark, sf_dir):
    return packages.npm_lock(project_files(spark, sf_dir))


@register("npm_manifest_packages", f"WITH {INVENTORY} SELECT 'r' || substr(name, 2) || '/package.json' AS path, * FROM full_inv WHERE ecosystem = 'npm' AND name[1] IN ('d', 'e')")
def npm_manifest_packages(spark, sf_dir):
    return packages.npm_manifest(project_files(spark, sf_dir))


@register("requirement_packages", f"WITH {INVENTORY} SELECT 'r' || regexp_replace(name, '^[A-Za-z]+', '') || '/requirements.txt' AS path, * FROM full_inv WHERE ecosystem = 'pypi'")
def requirement_packages(spark, sf_dir):
    return packages.requirements(project_files(spark, sf_dir))


@register("manifest_licenses", f"SELECT 'c' || p_partkey AS name, {LICENSE_SQL} AS license FROM part WHERE {KIND} = 3")
def manifest_licenses(spark, sf_dir):
    return packages.manifest_licenses(project_files(spark, sf_dir))


@register("locked_packages", f"""SELECT 'r' || p_partkey || '/Cargo.lock' AS path, 'c' || p_partkey AS name, p_size::VARCHAR AS version, 'registry' AS source, CASE WHEN p_size % 2 = 0 THEN 'ff' END AS checksum FROM part WHERE {KIND} = 3
    UNION ALL SELECT 'r' || p_partkey || '/Cargo.lock', 'o' || p_partkey, '1', NULL, NULL FROM part WHERE {KIND} = 3""")
def locked_packages(spark, sf_dir):
    return packages.locked(project_files(spark, sf_dir))


@register("lock_risks", f"""SELECT 'r' || p_partkey || '/' AS folder, '(workspace)' AS package, 'missing_lockfile' AS risk, 'high' AS severity FROM part WHERE {KIND} = 1
    UNION ALL SELECT 'r' || p_partkey || '/', 'free' || p_partkey, 'unpinned_dependency', 'medium' FROM part WHERE {KIND} = 2
    UNION ALL SELECT 'r' || p_partkey || '/', 'c' || p_partkey, 'missing_checksum', 'medium' FROM part WHERE {KIND} = 3 AND p_size % 2 = 1""")
def lock_risks(spark, sf_dir):
    return packages.lock_risks(project_files(spark, sf_dir))


@register("ecosystems", f"SELECT 'r' || p_partkey || '/' AS folder, CASE {KIND} WHEN 3 THEN 'rust' WHEN 2 THEN 'generic' ELSE 'node' END AS ecosystem FROM part")
def ecosystems(spark, sf_dir):
    return packages.ecosystems(project_files(spark, sf_dir))


@register("license_findings", f"""WITH {INVENTORY} SELECT name AS package, version, license, CASE license WHEN 'GPL-3.0' THEN 'copyleft-strong' ELSE 'copyleft-weak' END AS category, license = 'GPL-3.0' AS violation
    FROM full_inv WHERE license IN ('GPL-3.0', 'MPL-2.0')""")
def license_findings(spark, sf_dir):
    return metrics.license_findings(packages.inventory(project_files(spark, sf_dir)))


DOCS = ("docs/adr/1.md", "docs/adr/1.txt", "ARCHITECTURE.md", "docs/design/README.md", "CHANGELOG", "docs/CHANGELOG.md", "src/a.rs")


@register("design_documents", f"""WITH f AS (SELECT 'q' || p_partkey % 211 AS project, {sql_one_of(DOCS, 'p_partkey // 211 + p_size')} AS path FROM part),
    s AS (SELECT project, bool_or(path = 'docs/adr/1.md') AS adr, bool_or(path IN ('ARCHITECTURE.md', 'docs/design/README.md')) AS architecture, bool_or(path = 'CHANGELOG') AS changelog FROM f GROUP BY project),
    n AS (SELECT *, adr::INT + architecture::INT + changelog::INT AS pillars FROM s)
    SELECT *, pillars >= 1 AS passed, CASE WHEN pillars = 3 THEN 'design-docs-pass' WHEN pillars > 0 THEN 'design-docs-partial' ELSE 'design-docs-missing' END AS rule_id FROM n""")
def design_documents(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return packages.design_documents(p.select(F.concat(F.lit("q"), text(key() % 211)).alias("project"), one_of(DOCS, F.floor(key() / 211) + F.col("p_size")).alias("path")))


SCORES = ("CVSS:3.1/9.8", "CVSS:3.1/7.5", "CVSS:3.1/5.0", "CVSS:3.1/1.0")


@register("cargo_audit", f"""SELECT 'k' || p_partkey AS package, p_size::VARCHAR AS version, 'RUSTSEC-' || p_partkey AS advisory_id, (['critical', 'high', 'medium', 'low', 'unknown'])[1 + p_partkey % 5] AS severity, '?' AS title,
    CASE WHEN p_size % 2 = 0 THEN 'u' || p_size END AS url, 'rust' AS ecosystem FROM part""")
def cargo_audit(spark, sf_dir):
    cvss = F.when(key() % 5 < 4, F.concat(F.lit(',"cvss":"'), one_of((*SCORES, ""), key()), F.lit('"'))).otherwise("")
    url = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(',"url":"u'), text(F.col("p_size")), F.lit('"'))).otherwise("")
    body = F.concat(F.lit('{"vulnerabilities":{"list":[{"package":{"name":"k'), text(key()), F.lit('","version":"'), text(F.col("p_size")), F.lit('"},"advisory":{"id":"RUSTSEC-'), text(key()), F.lit('"'), url, cvss, F.lit("}}]}}"))
    return packages.cargo_audit(read(spark, sf_dir, "part").select(body.alias("content")))


@register("npm_audit", """SELECT 'n' || p_partkey AS package, '<' || p_size AS version, p_partkey::VARCHAR AS advisory_id, 'high' AS severity, 'T' || p_size AS title, NULL::VARCHAR AS url, 'node' AS ecosystem FROM part""")
def npm_audit(spark, sf_dir):
    body = F.concat(F.lit('{"vulnerabilities":{"n'), text(key()), F.lit('":{"severity":"high","range":"<'), text(F.col("p_size")), F.lit('","via":["other",{"source":'), text(key()), F.lit(',"title":"T'), text(F.col("p_size")), F.lit('"}]}}}'))
    return packages.npm_audit(read(spark, sf_dir, "part").select(body.alias("content")))


@register("safety_audit", """SELECT 's' || p_partkey AS package, p_size::VARCHAR AS version, p_partkey::VARCHAR AS advisory_id, 'unknown' AS severity, repeat('a', least(100, p_size * 4)::INT) AS title, NULL::VARCHAR AS url, 'python' AS ecosystem FROM part""")
def safety_audit(spark, sf_dir):
    body = F.concat(F.lit('[["s'), text(key()), F.lit('","<9","'), text(F.col("p_size")), F.lit('","'), F.expr("repeat('a', p_size * 4)"), F.lit('","'), text(key()), F.lit('"]]'))
    return packages.safety_audit(read(spark, sf_dir, "part").select(body.alias("content")))


@register("tool_findings", """SELECT 'f' || p_partkey AS file, p_size::BIGINT AS line, NULL::BIGINT AS "column", CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'low' END AS severity, 'm' || p_size AS message, 'RULE' AS rule_id, '' AS fix_hint FROM part
    UNION ALL SELECT 'g' || p_partkey, NULL, 7, 'low', 'd', 'own', 'fix' FROM part WHERE p_partkey % 3 = 0""")
def tool_findings(spark, sf_dir):
    own = F.when(key() % 3 == 0, F.concat(F.lit(',"results":[{"path":"g'), text(key()), F.lit('","column":7,"description":"d","rule":"own","fix_hint":"fix"},{"severity":"high"}]'))).otherwise("")
    severity = F.when(F.col("p_size") % 2 == 0, ',"severity":"high"').otherwise("")
    body = F.concat(F.lit('{"findings":[{"file":"f'), text(key()), F.lit('","line":'), text(F.col("p_size")), severity, F.lit(',"message":"m'), text(F.col("p_size")), F.lit('"}]'), own, F.lit("}"))
    return packages.findings_of(read(spark, sf_dir, "part").select(body.alias("content")), "RULE", "low")


@register("outdated_check", """SELECT 'o' || p_partkey AS path, CASE WHEN p_partkey % 7 > 0 THEN ((p_size % 4 > p_size % 3)::INT + (p_size % 5 > 2)::INT)::DOUBLE END AS score,
    p_partkey % 7 = 0 OR ((p_size % 4 > p_size % 3)::INT + (p_size % 5 > 2)::INT) <= 1 AS passed FROM part""")
def outdated_check(spark, sf_dir):
    s = F.col("p_size")
    body = F.concat(F.lit('{"dependencies":[{"latest":"'), text(s % 4), F.lit('.1","project":"'), text(s % 3), F.lit('.9"},{"latest":"'), text(s % 5), F.lit('","project":"2.0"},{"project":"1"}]}'))
    return packages.outdated_check(read(spark, sf_dir, "part").select(F.concat(F.lit("o"), text(key())).alias("path"), F.when(key() % 7 > 0, body).alias("content")), 1)


@register("skipped_checks", """SELECT event_id AS run, 'tool' || user_id % 9 AS name, value > 30 AS available, value <= 30 OR value <= 70 AS passed, CASE WHEN value > 30 THEN value END AS score,
    CASE WHEN value > 30 THEN 'ran' WHEN user_id % 2 = 0 THEN 'Skipped: not found' ELSE 'Skipped: tool unavailable or produced no JSON output' END AS message FROM events""")
def skipped_checks(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    ran = e.select(F.col("event_id").alias("run"), F.concat(F.lit("tool"), text(F.col("user_id") % 9)).alias("name"), (F.col("value") > 30).alias("available"), (F.col("value") <= 70).alias("passed"), F.col("value").alias("score"), F.lit("ran").alias("message"), F.when(F.col("user_id") % 2 == 0, "not found").alias("error"))
    return scoring.with_skipped(ran)


# --- history ------------------------------------------------------------------------------------


@register("git_churn", "SELECT 'src/' || o_custkey || '.rs' AS file, count(*) AS commits FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1")
def git_churn(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    name = F.concat(F.lit(" src/"), text(F.col("o_custkey")), F.lit(".rs"))
    return history.churn(o.select(F.explode(F.array(F.when(F.col("o_orderkey") % 5 > 0, name).otherwise(".git/x"), F.lit(""))).alias("value")))


SHA = "0123456789abcdef0123456789abcdef01234567"


@register("git_blame", """WITH e AS (SELECT event_id AS k, user_id AS u FROM events)
    SELECT 'f' || k || '.rs' AS file, unnest([1, 2, 5])::INT AS line, unnest(['a' || u, 'a' || u, 'b']) AS author, unnest(['1970-01-01', '1970-01-01', '2003-04-07']) AS date FROM e""")
def git_blame(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    head = lambda n: F.lit(f"{SHA} {n} {n} 1\n")
    body = F.concat(head(1), F.lit("author a"), text(F.col("user_id")), F.lit("\nauthor-time 3600\nsummary first\n\tlet a = 1;\n"), head(2), F.lit("\tauthor of code\n"), head(5), F.lit(f"author b\nauthor-time {86400 * (33 * 365 + 96)}\n\tx\n"))
    return history.blame(e.select(F.concat(F.lit("f"), text(F.col("event_id")), F.lit(".rs")).alias("path"), body.alias("content")))


@register("diff_hunks", """SELECT 'src/m' || event_id || '.rs' AS file, (event_id % 90)::INT AS start_line, (event_id % 90 + event_id % 4 + 1)::INT AS end_line FROM events
    UNION ALL SELECT 'src/m' || event_id || '.rs', 7, 7 FROM events UNION ALL SELECT 'src/m' || event_id || '.rs', 9, 9 FROM events""")
def diff_hunks(spark, sf_dir):
    k = F.col("event_id")
    name = F.concat(F.lit("src/m"), text(k), F.lit(".rs"))
    body = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a\n+++ b\n@@ -3,0 +"), text(k % 90), F.lit(","), text(k % 4 + 2), F.lit(" @@ fn x\n+y\n@@ -1 +7 @@\n@@ -5,2 +9,0 @@\ndiff --git a/r.py b/r.py\n@@ -1 +1 @@\n"))
    return history.hunks(read(spark, sf_dir, "events").select(F.concat(F.lit("d"), text(k)).alias("path"), body.alias("content")))


@register("mangled_coverage", """WITH r AS (SELECT o_custkey AS c, min(o_orderkey % 100)::INT AS line, sum(o_orderkey % 5)::BIGINT AS hits FROM orders GROUP BY 1)
    SELECT 'handle_' || (c % 9) AS function, min(line) AS line, sum(hits)::BIGINT AS hits FROM r GROUP BY 1 UNION ALL SELECT '_RNvCs' || (c + 1000) || 'x_4crate8handle_' || (c % 9), line, hits FROM r""")
def mangled_coverage(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    name = F.concat(F.lit("_RNvCs"), text(F.col("o_custkey") + 1000), F.lit("x_4crate8handle_"), text(F.col("o_custkey") % 9))
    fn, hit = F.concat(F.lit("FN:"), text(F.col("o_orderkey") % 100), F.lit(","), name), F.concat(F.lit(" FNDA:"), text(F.col("o_orderkey") % 5), F.lit(","), name)
    return corpus.lcov(o.select(F.explode(F.array(fn, hit)).alias("value")))


@register("debt_by_author", """WITH b AS (SELECT event_id % 500 AS file, event_id AS line, CASE WHEN user_id % 3 > 0 THEN 'a' || user_id % 20 END AS author FROM events)
    SELECT author, count(*) AS n FROM events d JOIN b ON b.file = d.event_id % 500 AND b.line = d.event_id WHERE author IS NOT NULL GROUP BY 1""")
def debt_by_author(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("file"), F.col("event_id").alias("line"), "user_id")
    author = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("a"), text(F.col("user_id") % 20)))
    blamed = e.select("file", "line", author.alias("author"), F.lit("1970-01-01").alias("date"))
    return history.by_author(history.with_blame(e.select("file", "line"), blamed))


# --- reports ------------------------------------------------------------------------------------

CRYPTO_SQL = """f AS (SELECT 'crypto' AS "check", p_partkey AS ord, 'x' || p_size AS file, p_size::BIGINT AS line, ({levels})[1 + p_size % 4] AS severity, 'm<' || p_size % 7 AS message, 'R' || p_size % 7 AS rule_id, 'h' || p_size % 7 AS fix_hint FROM part)""".format(
    levels="['critical', 'medium', 'low', 'none']"
)


def report_findings(spark, sf_dir):
    s = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.lit("crypto").alias("check"), key().alias("ord"), F.concat(F.lit("x"), text(s)).alias("file"), s.cast("long").alias("line"), F.lit(None).cast("long").alias("column"),
        one_of(("critical", "medium", "low", "none"), s).alias("severity"), F.concat(F.lit("m<"), text(s % 7)).alias("message"), F.concat(F.lit("R"), text(s % 7)).alias("rule_id"), F.concat(F.lit("h"), text(s % 7)).alias("fix_hint"),
    )


def report_checks(spark):
    schema = "check string, passed boolean, message string, severity string, rule_id string, help string, path string"
    return spark.createDataFrame([("crypto", False, "bad", "high", "C", "h", "."), ("debt", True, "fine", None, None, None, "."), ("sast", False, "none found", None, None, None, ".")], schema)


LEVEL = "CASE WHEN severity IN ('critical', 'high', 'error') THEN 'error' WHEN severity IN ('low', 'note') THEN 'note' ELSE 'warning' END"


@register("sarif_rules", f"""WITH {CRYPTO_SQL}, r AS (SELECT rule_id, min(ord) AS first, arg_min({LEVEL}, ord) AS level, arg_min(message, ord) AS message, arg_min(fix_hint, ord) AS fix_hint FROM f GROUP BY 1)
    SELECT rule_id, (row_number() OVER (ORDER BY first) - 1)::INT AS index, level, message, fix_hint FROM r""")
def sarif_rules(spark, sf_dir):
    return reports.sarif_rules(report_findings(spark, sf_dir))


@register("junit_report", f"""WITH {CRYPTO_SQL}, n AS (SELECT count(*) AS n FROM f)
    SELECT 0 AS part, 0::BIGINT AS ord, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<testsuites name="quillwork" tests="3" failures="2" time="0">' AS value
    UNION ALL SELECT 1, -1, '  <testsuite name="crypto" tests="' || n || '" failures="' || n || '" errors="0" skipped="0">' FROM n
    UNION ALL SELECT 1, ord, '    <testcase name="m&lt;' || rule_id[2:] || '" classname="quillwork.crypto">' || chr(10) || '      <failure message="m&lt;' || rule_id[2:] || '" type="' || rule_id || '">m&lt;' || rule_id[2:] || ' at ' || file || ':' || line || '</failure>' || chr(10) || '    </testcase>' FROM f
    UNION ALL SELECT 2, -1, '  <testsuite name="debt" tests="1" failures="0" errors="0" skipped="0">' || chr(10) || '    <testcase name="debt" classname="quillwork.debt" />'
    UNION ALL SELECT 3, -1, '  <testsuite name="sast" tests="1" failures="1" errors="0" skipped="0">' || chr(10) || '    <testcase name="sast" classname="quillwork.sast" />'
    UNION ALL SELECT unnest([1, 2, 3]), 4611686018427387904, '  </testsuite>' UNION ALL SELECT 2147483647, 0, '</testsuites>'""")
def junit_report(spark, sf_dir):
    return reports.junit_suites(report_findings(spark, sf_dir), report_checks(spark))


@register("sarif_report", f"""WITH {CRYPTO_SQL}, r AS (SELECT rule_id, min(ord) AS first, arg_min({LEVEL}, ord) AS level, arg_min(message, ord) AS message, arg_min(fix_hint, ord) AS fix_hint FROM f GROUP BY 1),
    i AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS index FROM r), m AS (SELECT min(ord) AS first FROM f)
    SELECT 0 AS part, 0::BIGINT AS ord, '{{"$schema":"{reports.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"quillwork","version":"1.0.0","rules":[' AS value
    UNION ALL SELECT 1, index, CASE WHEN index > 0 THEN ',' ELSE '' END || '{{"id":"' || rule_id || '","name":"' || rule_id || '","shortDescription":{{"text":"' || message || '"}},"fullDescription":{{"text":"' || fix_hint || '"}},"help":{{"text":"' || fix_hint || '"}},"defaultConfiguration":{{"level":"' || level || '"}}}}' FROM i
    UNION ALL SELECT 2, 0, ']}}}},"invocations":[{{"executionSuccessful":false,"exitCode":1}}],"results":['
    UNION ALL SELECT 3, ord, CASE WHEN ord > m.first THEN ',' ELSE '' END || '{{"ruleId":"' || f.rule_id || '","ruleIndex":' || index || ',"level":"' || {LEVEL} || '","message":{{"text":"' || f.message || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || line || '}}}}}}]}}' FROM f JOIN i USING (rule_id), m
    UNION ALL SELECT 4, 0, ']}}]}}'""")
def sarif_report(spark, sf_dir):
    return reports.sarif_log(report_findings(spark, sf_dir), report_checks(spark))


@register("failed_ndjson", """SELECT '{"tool":"crypto","severity":"high","rule_id":"C","message":"t' || p_size % 3 || '","help":"h","file":"x' || p_partkey || '","line":' || p_size || '}' AS value FROM part
    UNION ALL SELECT '{"tool":"sast","severity":"warning","rule_id":"sast","message":"none found","help":"","file":".","line":null}'""")
def failed_ndjson(spark, sf_dir):
    items = read(spark, sf_dir, "part").select(F.lit("crypto").alias("check"), F.concat(F.lit("t"), text(F.col("p_size") % 3)).alias("type"), F.concat(F.lit("x"), text(key())).alias("file"), F.col("p_size").cast("long").alias("line"))
    return reports.failed_ndjson(report_checks(spark), items)


@register("spdx_report", f"""WITH {INVENTORY}, n AS (SELECT *, row_number() OVER (ORDER BY left(purl, 24), purl) AS n FROM full_inv)
    SELECT 1 AS part, n AS ord, chr(10) || 'PackageName: ' || name || chr(10) || 'SPDXID: SPDXRef-Package-' || n || chr(10) || 'PackageVersion: ' || version || chr(10) || 'PackageDownloadLocation: ' || purl || chr(10) || 'FilesAnalyzed: false' || chr(10) || 'PackageLicenseConcluded: ' || license || chr(10) || 'PackageLicenseDeclared: ' || license AS value FROM n
    UNION ALL SELECT 0, 0, 'SPDXVersion: SPDX-2.3' || chr(10) || 'DataLicense: CC0-1.0' || chr(10) || 'SPDXID: SPDXRef-DOCUMENT' || chr(10) || 'DocumentName: app-1' || chr(10) || 'DocumentNamespace: https://quillwork/sbom/app-1-2024-01-01T00:00:00Z' || chr(10) || 'Creator: Tool: quillwork-1.0.0' || chr(10) || 'Created: 2024-01-01T00:00:00Z'""")
def spdx_report(spark, sf_dir):
    return reports.spdx(packages.inventory(project_files(spark, sf_dir)), "app", "1", "2024-01-01T00:00:00Z")


@register("cyclonedx_report", f"""WITH {INVENTORY}, n AS (SELECT *, row_number() OVER (ORDER BY left(purl, 24), purl) AS n FROM full_inv)
    SELECT 1 AS part, n AS ord, '    <component type="library" bom-ref="comp-' || n || '">' || chr(10) || '      <name>' || name || '</name>' || chr(10) || '      <version>' || version || '</version>' || chr(10)
        || CASE WHEN license = 'NOASSERTION' THEN '      <licenses><expression>NOASSERTION</expression></licenses>' ELSE '      <licenses><license><id>' || license || '</id></license></licenses>' END || chr(10) || '      <purl>' || purl || '</purl>' || chr(10) || '    </component>' AS value FROM n
    UNION ALL SELECT 0, 0, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<bom xmlns="http://cyclonedx.org/schema/bom/1.4" version="1">' || chr(10) || '  <metadata>' || chr(10) || '    <timestamp>T</timestamp>' || chr(10) || '    <component type="application">' || chr(10) || '      <name>app</name>' || chr(10) || '      <version>1</version>' || chr(10) || '    </component>' || chr(10) || '  </metadata>' || chr(10) || '  <components>'
    UNION ALL SELECT 2, 0, '  </components>' || chr(10) || '</bom>'""")
def cyclonedx_report(spark, sf_dir):
    return reports.cyclonedx(packages.inventory(project_files(spark, sf_dir)), "app", "1", "T")


# --- delta, filters, sets -----------------------------------------------------------------------


def ranges(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("src/s"), text(F.col("c_custkey")), F.lit(".rs")).alias("file"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    return c.select("file", F.concat(F.lit("fn"), text(F.col("k"))).alias("name"), (F.col("k") * 25).alias("line"), (F.col("k") * 25 + 20).alias("end_line"))


RANGES = """f AS (SELECT 'src/s' || c_custkey || '.rs' AS file, 'fn' || k AS name, k * 25 AS line, k * 25 + 20 AS end_line FROM customer, range(0, 10) t(k)),
    h AS (SELECT 's' || o_custkey || '.rs' AS file, o_orderkey % 250 AS a, o_orderkey % 250 + 10 AS b FROM orders), t AS (SELECT DISTINCT f.file, f.name FROM f JOIN h ON f.file = 'src/' || h.file AND h.a <= f.end_line AND h.b >= f.line)"""


def touched(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    hunks = o.select(F.concat(F.lit("s"), text(F.col("o_custkey")), F.lit(".rs")).alias("file"), (F.col("o_orderkey") % 250).alias("start_line"), (F.col("o_orderkey") % 250 + 10).alias("end_line"))
    return metrics.overlapping(hunks, ranges(spark, sf_dir))


@register("delta_reduction", f"WITH {RANGES} SELECT (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM t) AS affected, greatest(0.0, round(((SELECT count(*) FROM f) - (SELECT count(*) FROM t)) * 100.0 / (SELECT count(*) FROM f), 6))::DOUBLE AS pct")
def delta_reduction(spark, sf_dir):
    return metrics.reduction(ranges(spark, sf_dir), touched(spark, sf_dir))


@register("lines_in_affected_functions", f"""WITH {RANGES}, l AS (SELECT 'src/s' || o_custkey || '.rs' AS file, (o_orderkey * 7) % 250 AS line FROM orders)
    SELECT l.file, l.line FROM l WHERE EXISTS (SELECT 1 FROM f JOIN t USING (file, name) WHERE f.file = l.file AND l.line BETWEEN f.line AND f.end_line)""")
def lines_in_affected_functions(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("src/s"), text(F.col("o_custkey")), F.lit(".rs")).alias("file"), (F.col("o_orderkey") * 7 % 250).alias("line"))
    return metrics.lines_within(rows, ranges(spark, sf_dir), touched(spark, sf_dir))


@register("averages", "SELECT round(avg(value), 6) AS average FROM events UNION ALL SELECT 100.0")
def averages(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return metrics.average(e, "value", 0.0).unionByName(metrics.average(e.limit(0), "value", 100.0))


@register("severe_findings", f"""{CODE} SELECT path AS file, line, CASE WHEN contains(text, 'Md5::') THEN 'critical' WHEN contains(text, 'eval(') THEN 'medium' ELSE 'high' END AS severity FROM lines
    WHERE contains(text, 'Md5::') OR contains(text, 'eval(') OR contains(text, 'unsafe') ORDER BY 1, 2""")
def severe_findings(spark, sf_dir):
    t = F.col("text")
    found = code_lines(spark, sf_dir).filter(t.contains("Md5::") | t.contains("eval(") | t.contains("unsafe") | t.contains("HACK"))
    severity = F.when(t.contains("Md5::"), "critical").when(t.contains("eval("), "medium").when(t.contains("unsafe"), "high").otherwise("low")
    return scans.by_severity(scans.at_least(found.select(F.col("path").alias("file"), "line", severity.alias("severity")), "medium"))


@register("missing_baseline_tools", """WITH t AS (SELECT DISTINCT user_id % 700 AS run, 'tool' || event_id % 9 AS tool, value >= 50 AS now FROM events)
    SELECT run, tool FROM t WHERE NOT now EXCEPT SELECT run, tool FROM t WHERE now""")
def missing_baseline_tools(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    side = lambda now: e.filter((F.col("value") >= 50) == now).select((F.col("user_id") % 700).alias("run"), F.concat(F.lit("tool"), text(F.col("event_id") % 9)).alias("tool"))
    return lifecycle.lost_tools(side(False), side(True), ["run"])


TOOLS = tuple(n for names in scoring.CATEGORIES.values() for n in names)


@register("policy_errors", f"""WITH c AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'C' || p_partkey END AS id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS name, {sql_one_of((*TOOLS[:5], 'nope'), 'p_size')} AS tool FROM part)
    SELECT id, 'missing id' AS error FROM c WHERE id = '' UNION ALL SELECT id, 'missing name' FROM c WHERE name = '' UNION ALL SELECT id, 'unknown tool nope' FROM c WHERE tool = 'nope'""")
def policy_errors(spark, sf_dir):
    controls = read(spark, sf_dir, "part").select(F.when(key() % 11 == 0, "").otherwise(F.concat(F.lit("C"), text(key()))).alias("id"), F.when(key() % 13 == 0, "").otherwise(F.col("p_name")).alias("name"), one_of((*TOOLS[:5], "nope"), F.col("p_size")).alias("tool"))
    return lifecycle.policy_errors(controls, spark.createDataFrame([(t,) for t in TOOLS], "tool string"))


@register("cohesion", """WITH f AS (SELECT DISTINCT 'T' || l_orderkey AS type, 'm' || l_linenumber AS method, 'f' || l_suppkey % 4 AS field FROM lineitem),
    n AS (SELECT type, count(DISTINCT method) AS methods FROM f GROUP BY 1 HAVING count(DISTINCT method) > 1), e AS (SELECT DISTINCT a.type, a.method AS x, b.method AS y FROM f a JOIN f b USING (type, field)),
    c1 AS (SELECT type, x, min(y) AS r FROM e GROUP BY 1, 2), c2 AS (SELECT e.type, e.x, min(c.r) AS r FROM e JOIN c1 c ON c.type = e.type AND c.x = e.y GROUP BY 1, 2), c3 AS (SELECT e.type, e.x, min(c.r) AS r FROM e JOIN c2 c ON c.type = e.type AND c.x = e.y GROUP BY 1, 2),
    c4 AS (SELECT e.type, e.x, min(c.r) AS r FROM e JOIN c3 c ON c.type = e.type AND c.x = e.y GROUP BY 1, 2), c5 AS (SELECT e.type, e.x, min(c.r) AS r FROM e JOIN c4 c ON c.type = e.type AND c.x = e.y GROUP BY 1, 2),
    c6 AS (SELECT e.type, e.x, min(c.r) AS r FROM e JOIN c5 c ON c.type = e.type AND c.x = e.y GROUP BY 1, 2), c7 AS (SELECT e.type, e.x, min(c.r) AS r FROM e JOIN c6 c ON c.type = e.type AND c.x = e.y GROUP BY 1, 2)
    SELECT 'a' AS path, type, methods::INT AS methods, count(DISTINCT r)::INT AS components FROM c7 JOIN n USING (type) GROUP BY type, methods""")
def cohesion(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return graphs.lcom4(l.select(F.lit("a").alias("path"), F.concat(F.lit("T"), text(F.col("l_orderkey"))).alias("type"), F.concat(F.lit("m"), text(F.col("l_linenumber"))).alias("method"), F.concat(F.lit("f"), text(F.col("l_suppkey") % 4)).alias("field")))


@register("sarif_results", f"""WITH {CRYPTO_SQL} SELECT '{{"ruleId":"' || rule_id || '","level":"' || {LEVEL} || '","message":{{"text":"' || rule_id || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || greatest(line, 1) || '}}}}}}]}}' AS value FROM f""")
def sarif_results(spark, sf_dir):
    return sinks.sarif_results(report_findings(spark, sf_dir).withColumn("line", F.col("line").cast("int")))


@register("markdown_report", """WITH r AS (SELECT 'x' || p_size AS file, count(*) AS n, sum(CASE p_size % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END)::BIGINT AS score FROM part GROUP BY 1)
    SELECT '| ' || file || ' | ' || n || ' | ' || score || ' |' AS value FROM r""")
def markdown_report(spark, sf_dir):
    return sinks.markdown_rows(scoring.file_rollup(report_findings(spark, sf_dir)))


