"""Registered queries and their SQL twins.

Corpora: ``documents`` as text files, and a synthetic source tree made from ``part``. Both sides
derive them from the same rules and literal tables, so each query has rows at every scale.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, rule_tables, scans, scoring
from ..operators.rule_tables import Rule
from ..sources import corpus
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# --- SQL twins of the shared pieces -------------------------------------------------------------


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case(rules: Sequence[Rule], column: str, part: str) -> str:
    hit = lambda r: f"contains({column}, {text(r.pattern)})" + (f" AND contains({column}, {text(r.also)})" if r.also else "")
    return "CASE " + " ".join(f"WHEN {hit(r)} THEN {text(getattr(r, part))}" for r in rules) + " END"


def cases(rules: Sequence[Rule], column: str = "text") -> str:
    return f"SELECT path AS file, line, {case(rules, column, 'id')} AS rule_id, {case(rules, column, 'category')} AS category, {case(rules, column, 'severity')} AS severity"


def among(values: Sequence[str]) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


TEMPLATE_LIST = "[" + ", ".join(map(text, corpus.TEMPLATES)) + "]"
CODE_FILES = f"""files AS (
    SELECT CASE WHEN p_partkey % 7 = 0 THEN 'tests/test_' ELSE 'src/unit_' END || p_partkey || '.' || ({list(corpus.EXTENSIONS)!r})[1 + p_partkey % {len(corpus.EXTENSIONS)}] AS path,
           array_to_string([({TEMPLATE_LIST})[1 + (p_partkey * (2 * j + 1) + j) % {len(corpus.TEMPLATES)}] FOR j IN range({corpus.TEMPLATE_LINES})], chr(10)) AS content
    FROM part)"""
DOC_FILES = "files AS (SELECT source || '/' || doc_id || '.txt' AS path, text AS content FROM documents)"
LINES = r"""pieces AS (SELECT path, regexp_split_to_array(coalesce(content, ''), '\r?\n') AS p FROM files),
whole AS (SELECT path, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM pieces),
lines AS (SELECT path, line, text, regexp_replace(text, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS trimmed, regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) AS ext
          FROM (SELECT path, unnest(range(1, len(p) + 1))::INT AS line, unnest(p) AS text FROM whole))"""
CODE, DOCS = f"WITH {CODE_FILES}, {LINES}", f"WITH {DOC_FILES}, {LINES}"
DOCSTRING = "(ext = 'py' AND (starts_with(trimmed, '\'\'\'\'\'\'') OR starts_with(trimmed, '\"\"\"')))"
ACCESS_LIVE = rf"NOT regexp_matches(trimmed, '^(//|--|<!--|;|%)') AND NOT (starts_with(trimmed, '#') AND NOT regexp_matches(trimmed, '^#[\[!#]')) AND NOT {DOCSTRING} AND NOT regexp_matches(trimmed, '^(pattern|description|remediation|rule_id|severity|also):')"
WEIGHT = "CASE WHEN severity = 'critical' THEN 4 WHEN severity IN ('high', 'error') THEN 3 WHEN severity IN ('medium', 'warning') THEN 2 WHEN severity = 'low' THEN 1 ELSE 0 END"


LIVE = """, events AS (SELECT *, CASE WHEN starts_with(trimmed, '/*') AND NOT contains(trimmed, '*/') THEN 1 WHEN contains(trimmed, '*/') THEN 0 END AS event FROM lines),
live AS (SELECT * FROM (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM events)
         WHERE open = 0 AND NOT starts_with(trimmed, '/*'))"""


def rollup(found: str, head: str) -> str:
    return f"""{head}, found AS ({found})
    SELECT file, count(*) AS n_findings, sum({WEIGHT})::BIGINT AS score, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
           count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
    FROM found WHERE rule_id IS NOT NULL GROUP BY file"""


def of(found: str, head: str = CODE) -> str:
    return f"{head}, found AS ({found}) SELECT * FROM found WHERE rule_id IS NOT NULL"


def code_lines(spark: SparkSession, sf_dir: str, *states: str) -> DataFrame:
    return corpus.lines(corpus.code(spark, sf_dir), *states)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that trees are made of, a file each."""
    return corpus.spread(read(spark, sf_dir, "part"))


# --- sources and scanners -----------------------------------------------------------------------

ACCESS = f"{cases(scans.LITERAL_ACCESS)} FROM live WHERE {ACCESS_LIVE}"
SAST = f"{cases(rule_tables.SAST)} FROM live WHERE ext IN {among(scans.SAST_EXTENSIONS)} AND NOT regexp_matches(trimmed, '^(//|#|--|<!--|;|%)') AND NOT {DOCSTRING}"


@register("access_control_rollup", rollup(ACCESS, DOCS + LIVE))
def access_control_rollup(spark, sf_dir):
    return scoring.file_rollup(scans.access_control(corpus.lines(corpus.documents(spark, sf_dir))))


@register("document_lines", f"{DOCS} SELECT path, count(*) AS n_lines, count(*) FILTER (trimmed = '') AS n_blank, sum(length(trimmed))::BIGINT AS n_chars FROM lines GROUP BY path")
def document_lines(spark, sf_dir):
    lines = corpus.lines(corpus.documents(spark, sf_dir))
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("trimmed") == "", 1)).alias("n_blank"), F.sum(F.length("trimmed")).alias("n_chars"))


LANGUAGE_CASE = "CASE " + " ".join(f"WHEN ext = {text(k)} THEN {text(v)}" for k, v in corpus.LANGUAGES.items()) + " ELSE 'unknown' END"


@register("languages", rf"WITH {CODE_FILES} SELECT {LANGUAGE_CASE} AS lang, count(*) AS n_files FROM (SELECT lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM files) GROUP BY 1")
def languages(spark, sf_dir):
    return corpus.with_language(corpus.code(spark, sf_dir)).groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"))




@register("sast_findings", of(SAST, CODE + LIVE))
def sast_findings(spark, sf_dir):
    return scans.sast(code_lines(spark, sf_dir))


@register("crypto_findings", of(f"{cases(rule_tables.CRYPTO)} FROM lines WHERE ext IN {among(scans.CRYPTO_EXTENSIONS)} AND NOT regexp_matches(trimmed, '^(//|#|\\*)')"))
def crypto_findings(spark, sf_dir):
    return scans.crypto(code_lines(spark, sf_dir))


@register("access_control_findings", of(ACCESS, CODE + LIVE))
def access_control_findings(spark, sf_dir):
    return scans.access_control(code_lines(spark, sf_dir))


@register("secret_assignments", of(f"{cases(rule_tables.SECRETS, 'lower(text)')} FROM lines WHERE contains(text, '=') OR contains(text, ':')"))
def secret_assignments(spark, sf_dir):
    return scans.secret_assignments(code_lines(spark, sf_dir))


def errors_of(head: str) -> str:
    first = " ".join(f"WHEN contains(text, {text(r.pattern)}) THEN {{'r': '{r.id}', 's': '{r.severity}'}}" for r in rule_tables.ERRORS)
    kinds = (
        ("discard", "low", "ext = 'rs' AND starts_with(trimmed, 'let _ =')"),
        ("bare_except", "high", "ext = 'py' AND trimmed IN ('except:', 'except Exception:', 'except Exception as e:') AND after IN ('pass', '')"),
        ("empty_catch", "medium", "ext IN ('js', 'ts', 'tsx') AND contains(trimmed, '.catch(') AND (contains(trimmed, '{}') OR ends_with(trimmed, '.catch()'))"),
        ("empty_catch", "high", "ext IN ('js', 'ts', 'tsx') AND trimmed = '} catch (e) {' AND after = '}'"),
        ("discard", "medium", "ext = 'go' AND (starts_with(trimmed, '_ =') OR starts_with(trimmed, '_, _ ='))"),
        ("empty_error_handler", "high", "ext = 'go' AND starts_with(trimmed, 'if err != nil {') AND after = '}'"),
    )
    rows = " ".join(f"UNION ALL SELECT file, line, '{rule}', 'error_handling', '{severity}' FROM live WHERE {when}" for rule, severity, when in kinds)
    return f"""{head}, e AS (SELECT path AS file, *, coalesce(lead(trimmed) OVER (PARTITION BY path ORDER BY line), '') AS after,
            bool_or(contains(trimmed, '#[cfg(test)]') OR contains(trimmed, 'mod tests')) OVER (PARTITION BY path ORDER BY line) AS seen FROM lines),
        live AS (SELECT *, CASE WHEN ext = 'rs' THEN CASE {first} END END AS f FROM e WHERE NOT seen AND NOT starts_with(trimmed, '//') AND NOT starts_with(trimmed, '#'))
        SELECT file, line, f.r AS rule_id, 'error_handling' AS category, f.s AS severity FROM live WHERE f IS NOT NULL {rows}"""


@register("error_handling", errors_of(CODE))
def error_handling(spark, sf_dir):
    return scans.error_handling(code_lines(spark, sf_dir, "after", "ext"))


@register("debt_markers", f"{CODE} SELECT path AS file, line, marker FROM lines, (SELECT unnest({list(rule_tables.DEBT_CHECK)!r}) AS marker) WHERE regexp_matches(trimmed, '^(//|/\\*|\\*)') AND contains(text, marker)")
def debt_markers(spark, sf_dir):
    return scans.debt_markers(code_lines(spark, sf_dir))


FIRST_DEBT = "CASE " + " ".join(f"WHEN regexp_matches(text, '{m}[:( ]') THEN '{m}'" for m in rule_tables.DEBT_TOOL) + " END"


@register("debt_by_type", f"{CODE} SELECT marker, count(*) AS n, count(DISTINCT path) AS files FROM (SELECT path, {FIRST_DEBT} AS marker FROM lines) WHERE marker IS NOT NULL GROUP BY marker")
def debt_by_type(spark, sf_dir):
    return scans.debt_first(code_lines(spark, sf_dir)).groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


def pattern_case(patterns: Sequence[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(text, {text(p)}) THEN {text(p)}" for p in patterns) + " END"


TEST_FILE = "(contains(path, 'test') OR contains(path, 'spec'))"


@register("raw_logs", f"{CODE} SELECT * FROM (SELECT path AS file, line, {pattern_case(scans.RAW_LOGS)} AS pattern FROM lines WHERE NOT {TEST_FILE} AND NOT regexp_matches(trimmed, '^(//|#)')) WHERE pattern IS NOT NULL")
def raw_logs(spark, sf_dir):
    return scans.raw_logs(code_lines(spark, sf_dir))


@register("nondeterminism", f"{CODE} SELECT * FROM (SELECT path AS file, line, {pattern_case(scans.NONDETERMINISM)} AS pattern FROM lines WHERE {TEST_FILE} OR ext = 'rs') WHERE pattern IS NOT NULL")
def nondeterminism(spark, sf_dir):
    return scans.nondeterminism(code_lines(spark, sf_dir))


@register("unguarded_unwraps", f"""{CODE} SELECT path AS file, line FROM (SELECT *, lag(text, 1, '') OVER (PARTITION BY path ORDER BY line) AS before FROM lines WHERE ext = 'rs')
    WHERE (contains(text, '.unwrap()') OR contains(text, '.expect(')) AND NOT contains(before, 'SAFETY') AND NOT contains(text, '.context(')""")
def unguarded_unwraps(spark, sf_dir):
    return scans.unguarded_unwraps(code_lines(spark, sf_dir, "before"))


# --- metrics ------------------------------------------------------------------------------------


@register("comment_ratio", rf"""{CODE}, kinds AS (SELECT path, CASE WHEN trimmed = '' THEN 'blank'
        WHEN ext IN ('rs', 'js', 'go', 'java') AND regexp_matches(trimmed, '^(//|/\*|\*)') AND NOT (ext = 'rs' AND regexp_matches(trimmed, '^(///|//!|/\*\*)')) AND NOT (ext IN ('js', 'java') AND regexp_matches(trimmed, '^(/\*\*|\* |\*/)')) THEN 'comment'
        WHEN ext = 'py' AND starts_with(trimmed, '#') THEN 'comment' WHEN ext = 'md' AND regexp_matches(trimmed, '^(//|#)') THEN 'comment' ELSE 'code' END AS kind FROM lines),
    n AS (SELECT path AS file, count(*) FILTER (kind = 'code') AS code, count(*) FILTER (kind = 'comment') AS comment, count(*) FILTER (kind = 'blank') AS blank FROM kinds GROUP BY path)
    SELECT *, round(CASE WHEN code + comment > 0 THEN comment / (code + comment) ELSE 1.0 END, 6)::DOUBLE AS ratio, round(comment / (code + comment), 6) < 0.2 AND code + comment > 10 AS below FROM n""")
def comment_ratio(spark, sf_dir):
    return metrics.comment_ratio(code_lines(spark, sf_dir), 0.2)


@register("long_files", f"{DOCS} SELECT path AS file, count(*) AS n_lines FROM lines GROUP BY path HAVING count(*) > 20")
def long_files(spark, sf_dir):
    return metrics.long_files(corpus.lines(corpus.documents(spark, sf_dir)), 20)


FUNCTIONS = "fns AS (SELECT 'f' || l_suppkey AS file, 'fn' || l_orderkey || '_' || l_linenumber AS name, (l_quantity::BIGINT % 13)::INT AS complexity FROM lineitem)"


def function_table(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file"), F.concat(F.lit("fn"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_quantity").cast("long") % 13).cast("int").alias("complexity"))


@register("crap", f"""WITH {FUNCTIONS}, cov AS (SELECT 'fn' || o_orderkey || '_1' AS name, max(o_orderkey % 3) AS hits FROM orders GROUP BY 1),
    s AS (SELECT file, name, complexity, complexity::DOUBLE * complexity * pow(1 - CASE WHEN coalesce(hits, 0) > 0 THEN 1.0 ELSE 0.0 END, 3) + complexity AS crap FROM fns LEFT JOIN cov USING (name))
    SELECT *, CASE WHEN crap > 30 THEN 'crappy' WHEN crap > 20 THEN 'acceptable' WHEN crap > 10 THEN 'good' ELSE 'excellent' END AS band FROM s""")
def crap(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    cov = o.select(F.concat(F.lit("fn"), F.col("o_orderkey").cast("string"), F.lit("_1")).alias("function"), (F.col("o_orderkey") % 3).alias("hits"))
    return metrics.crap(function_table(spark, sf_dir), cov)


@register("risk", f"""WITH {FUNCTIONS}, churn AS (SELECT 'f' || s_suppkey AS file, (s_suppkey % 40) AS commits FROM supplier), cx AS (SELECT file, sum(complexity)::BIGINT AS complexity FROM fns GROUP BY file),
    r AS (SELECT file, commits, complexity, least(100, floor(sqrt(commits) * complexity / 20))::INT AS risk FROM churn JOIN cx USING (file))
    SELECT *, CASE WHEN risk >= 70 THEN 'DANGER' WHEN risk >= 40 THEN 'HIGH' WHEN risk >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")
def risk(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file"), (F.col("s_suppkey") % 40).alias("commits"))
    return metrics.risk(s, function_table(spark, sf_dir))


@register("hottest_functions", f"WITH {FUNCTIONS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY complexity DESC, name)::INT AS rank FROM fns WHERE complexity > 3) WHERE rank <= 3")
def hottest_functions(spark, sf_dir):
    return metrics.hottest(function_table(spark, sf_dir))


@register("coupling", """WITH e AS (SELECT DISTINCT 'm' || l_suppkey % 97 AS src, 'm' || l_partkey % 89 AS dst FROM lineitem),
    o AS (SELECT src AS module, count(*) AS fan_out FROM e GROUP BY 1), i AS (SELECT dst AS module, count(*) AS fan_in FROM e GROUP BY 1),
    b AS (SELECT module, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in FROM o FULL JOIN i USING (module))
    SELECT *, round(fan_out / (fan_in + fan_out), 6) AS instability FROM b""")
def coupling(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    m = lambda c, k: F.concat(F.lit("m"), (F.col(c) % k).cast("string"))
    return metrics.coupling(l.select(m("l_suppkey", 97).alias("src"), m("l_partkey", 89).alias("dst")))


LICENSES = ("MIT", "LGPL-3.0", "GPL-3.0-only", "MPL-2.0", "", "Foo", "apache-2.0", "AGPL-3.0", "GPL", "unknown")


@register("license_classes", f"""WITH n AS (SELECT p_partkey, ({list(LICENSES)!r})[1 + p_partkey % {len(LICENSES)}] AS license FROM part), u AS (SELECT *, upper(trim(license)) AS u FROM n)
    SELECT CASE WHEN contains(u, 'AGPL') THEN 'copyleft-strong' WHEN contains(u, 'LGPL') THEN 'copyleft-weak' WHEN regexp_matches(u, 'GPL-[123]') OR u = 'GPL' THEN 'copyleft-strong'
        WHEN regexp_matches(u, 'MPL|EUPL|CDDL|EPL') THEN 'copyleft-weak' WHEN regexp_matches(u, 'MIT|BSD|APACHE|ISC|ZLIB|WTFPL|PSF|CC0|UNLICENSE|BOOST') THEN 'permissive'
        WHEN u IN ('', 'UNKNOWN', 'NONE') THEN 'unknown' ELSE 'other' END AS class, license, count(*) AS n FROM u GROUP BY 1, 2""")
def license_classes(spark, sf_dir):
    names = F.element_at(F.array(*[F.lit(x) for x in LICENSES]), (F.pmod("p_partkey", F.lit(len(LICENSES))) + 1).cast("int"))
    p = read(spark, sf_dir, "part").select(names.alias("license"))
    return p.groupBy(metrics.license_class(F.col("license")).alias("class"), "license").agg(F.count(F.lit(1)).alias("n"))


@register("entropy", "SELECT p_partkey, round(list_aggregate(string_split(p_name, ''), 'entropy'), 6) AS entropy FROM part")
def entropy(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(metrics.entropy(F.col("p_name")), 6).alias("entropy"))


POPULAR = ("serde", "tokio", "requests", "numpy", "react", "lodash", "express", "django", "flask", "log")
NAMES = ("serdee", "serde", "lug", "tokoi", "tokyo", "request", "nunpy", "reactt", "lodash", "flusk")


@register("typosquats", f"""WITH n AS (SELECT DISTINCT ({list(NAMES)!r})[1 + p_partkey % {len(NAMES)}] AS name FROM part), p AS (SELECT unnest({list(POPULAR)!r}) AS popular, unnest(range({len(POPULAR)})) AS ord)
    SELECT name, arg_min(popular, ord) AS "like" FROM n, p WHERE length(popular) > 3 AND levenshtein(lower(name), popular) = 1 GROUP BY name""")
def typosquats(spark, sf_dir):
    names = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.pmod("p_partkey", F.lit(len(NAMES))) + 1).cast("int"))
    popular = spark.createDataFrame(list(enumerate(POPULAR)), "ord int, popular string")
    return metrics.typosquats(read(spark, sf_dir, "part").select(names.alias("name")).distinct(), popular)


@register("bill_of_materials", """WITH p AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'cargo' ELSE 'npm' END AS ecosystem, p_brand AS name, (p_size % 5)::VARCHAR AS version, p_partkey AS ord FROM part)
    SELECT ecosystem, name, version, 'pkg:' || ecosystem || '/' || name || '@' || version AS purl FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, name, version ORDER BY ord) AS n FROM p) WHERE n = 1""")
def bill_of_materials(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return metrics.bill_of_materials(p.select(F.when(F.col("p_size") % 2 == 0, "cargo").otherwise("npm").alias("ecosystem"), F.col("p_brand").alias("name"), (F.col("p_size") % 5).cast("string").alias("version"), F.col("p_partkey").alias("ord")))


@register("changed_functions", """WITH h AS (SELECT 's' || o_custkey AS file, o_orderkey % 500 AS a, o_orderkey % 500 + 10 AS b FROM orders),
    f AS (SELECT 's' || c_custkey AS file, 'fn' || k AS name, k * 25 AS line, k * 25 + 20 AS end_line FROM customer, range(0, 20) t(k))
    SELECT DISTINCT f.file, f.name FROM h JOIN f ON h.file = f.file AND h.a <= f.end_line AND h.b >= f.line""")
def changed_functions(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("file"), (F.col("o_orderkey") % 500).alias("start_line"), (F.col("o_orderkey") % 500 + 10).alias("end_line"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("file"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    return metrics.overlapping(o, c.select("file", F.concat(F.lit("fn"), F.col("k").cast("string")).alias("name"), (F.col("k") * 25).alias("line"), (F.col("k") * 25 + 20).alias("end_line")))


@register("line_islands", """WITH l AS (SELECT DISTINCT user_id AS file, event_id % 300 AS line FROM events), g AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM l)
    SELECT file, min(line) AS first, max(line) AS last FROM g GROUP BY file, g""")
def line_islands(spark, sf_dir):
    return metrics.islands(read(spark, sf_dir, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 300).alias("line")))


# --- scoring and life cycle ---------------------------------------------------------------------

CHECK_NAMES = tuple(n for names in scoring.CATEGORIES.values() for n in names)
CHECKS = f"checks AS (SELECT 'run' || o_orderkey % 50 AS run, ({list(CHECK_NAMES)!r})[1 + o_orderkey % {len(CHECK_NAMES)}] AS name, o_custkey % 3 <> 0 AS passed, o_custkey % 11 = 0 AS skipped FROM orders)"


def check_table(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    name = F.element_at(F.array(*[F.lit(x) for x in CHECK_NAMES]), (F.pmod("o_orderkey", F.lit(len(CHECK_NAMES))) + 1).cast("int"))
    return o.select(F.concat(F.lit("run"), (F.col("o_orderkey") % 50).cast("string")).alias("run"), name.alias("name"), (F.col("o_custkey") % 3 != 0).alias("passed"), (F.col("o_custkey") % 11 == 0).alias("skipped"))


GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END"
HEALTH_WEIGHT = f"CASE WHEN name IN {among(scoring.HEALTH_HEAVY)} THEN 3 WHEN name IN {among(scoring.HEALTH_MIDDLE)} THEN 2 ELSE 1 END"


@register("health_score", f"WITH {CHECKS}, s AS (SELECT run, floor(100 * sum(CASE WHEN passed THEN {HEALTH_WEIGHT} ELSE 0 END) / sum({HEALTH_WEIGHT}))::INT AS score FROM checks GROUP BY run) SELECT *, {GRADE} AS grade FROM s")
def health_score(spark, sf_dir):
    return scoring.health(check_table(spark, sf_dir), ["run"])


CATEGORY_CASE = "CASE " + " ".join(f"WHEN name IN {among(v)} THEN '{k}'" for k, v in scoring.CATEGORIES.items()) + " END"
WEIGHT_CASE = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.CATEGORY_WEIGHTS.items()) + " END"
KILLERS = among(scoring.GATE_KILLERS)


@register("audit", f"""WITH {CHECKS}, r AS (SELECT run, category, count(*) FILTER (passed) * 100.0::DOUBLE / count(*) AS rate FROM (SELECT *, {CATEGORY_CASE} AS category FROM checks) WHERE category IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT run, floor(round(sum(rate * {WEIGHT_CASE}) / sum({WEIGHT_CASE}), 6))::INT AS score FROM r GROUP BY run),
    g AS (SELECT run, count(*) FILTER (skipped) AS skips, count(DISTINCT name) FILTER (passed AND name IN {KILLERS}) AS alive, count(*) FILTER (NOT passed AND name IN {KILLERS}) AS dead FROM checks GROUP BY run)
    SELECT run, score, {GRADE} AS grade, CASE WHEN skips >= 5 THEN 'DISCLAIMER' WHEN alive < 4 OR dead > 0 THEN 'ADVERSE' WHEN score >= 80 THEN 'UNQUALIFIED' ELSE 'QUALIFIED' END AS opinion FROM g JOIN s USING (run)""")
def audit(spark, sf_dir):
    return scoring.audit(check_table(spark, sf_dir), ["run"])


@register("check_difference", f"""WITH {CHECKS}, b AS (SELECT name, run, bool_and(passed) AS was FROM checks WHERE name <> 'sbom' GROUP BY 1, 2), a AS (SELECT name, 'run' || (substr(run, 4)::INT + 1) AS run, bool_and(passed) AS now FROM checks WHERE name <> 'fuzz' GROUP BY 1, 2)
    SELECT name, run, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN was AND NOT now THEN 'regressed' WHEN NOT was AND now THEN 'improved' ELSE 'same' END AS status FROM b FULL JOIN a USING (name, run)""")
def check_difference(spark, sf_dir):
    checks = check_table(spark, sf_dir)
    merged = lambda skip, run: checks.filter(F.col("name") != skip).groupBy("name", run.alias("run")).agg(F.bool_and("passed").alias("passed"))
    later = F.concat(F.lit("run"), (F.substring("run", 4, 9).cast("int") + 1).cast("string"))
    return scoring.difference(merged("sbom", F.col("run")), merged("fuzz", later), ["name", "run"])


@register("sast_rollup", rollup(SAST, CODE + LIVE))
def sast_rollup(spark, sf_dir):
    return scoring.file_rollup(scans.sast(code_lines(spark, sf_dir)))


@register("open_findings", f"""{CODE}{LIVE}, found AS ({ACCESS}), e AS (SELECT 'ACL-CRED-001' AS rule_id, path AS file FROM files WHERE length(path) % 2 = 0)
    SELECT * FROM found WHERE rule_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.rule_id = found.rule_id AND e.file = found.file)""")
def open_findings(spark, sf_dir):
    files = corpus.code(spark, sf_dir)
    excepted = files.select(F.lit("ACL-CRED-001").alias("rule_id"), F.col("path").alias("file"), (F.length("path") % 2 == 0).alias("approved"))
    found = scoring.without_exceptions(scans.access_control(corpus.lines(files)), excepted)
    return found.select("file", "line", "rule_id", "category", "severity")


@register("sarif_levels", f"""{CODE}, found AS ({cases(rule_tables.CRYPTO)} FROM lines WHERE ext IN {among(scans.CRYPTO_EXTENSIONS)} AND NOT regexp_matches(trimmed, '^(//|#|\\*)'))
    SELECT rule_id, CASE WHEN severity IN ('critical', 'high', 'error') THEN 'error' WHEN severity IN ('low', 'note') THEN 'note' ELSE 'warning' END AS level, count(*) AS n FROM found WHERE rule_id IS NOT NULL GROUP BY 1, 2""")
def sarif_levels(spark, sf_dir):
    return scans.crypto(code_lines(spark, sf_dir)).groupBy("rule_id", scoring.sarif_level(F.col("severity")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@register("latest_runs", "SELECT event_id AS run_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_runs(spark, sf_dir):
    return scoring.latest(read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), "ts", "event_type", "value"), 50)


CYCLE_CHANGES = """WITH s AS (SELECT user_id, event_id, value > 50 AS ok, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, event_id, CASE WHEN ok THEN 'fail_to_pass' ELSE 'pass_to_fail' END AS change FROM s WHERE before IS NOT NULL AND before <> ok"""


def user_cycles(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") > 50).alias("passed"))


@register("cycle_changes", CYCLE_CHANGES)
def cycle_changes(spark, sf_dir):
    return watch.changes(user_cycles(spark, sf_dir), ["user_id"], ["ts", "event_id"]).drop("ts")


@register("cycle_state_changes", CYCLE_CHANGES)
def cycle_state_changes(spark, sf_dir):
    return watch.stateful_changes(user_cycles(spark, sf_dir), ["user_id"], ["ts", "event_id"]).drop("ts")
