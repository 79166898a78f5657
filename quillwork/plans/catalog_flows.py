"""Registered queries over checks that look at several lines, and over what functions declare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows, imports, metrics, rule_tables, scans, secret_rules, surface
from ..sources import corpus
from .catalog import CODE_FILES, LINES, among, case, coupling, parts, read, register, text

#: A second synthetic tree, in five languages: what several lines of a file say together.
FLOW_LINES = (
    "let api_key = load();", "log::info!(api_key);", "println!(plain);", "let total = a + b;", "print(token)", "std::fs::write(path, api_key);", "dbg!(api_key)",
    "/// Documented.", "pub fn run(data: &[u8], n: u32) {", "// @sensitive", "let plain = Secret::new();", "    x = true && y == z;", "pub async fn go_on(p: String) {", "#[sensitive]",
    "#[test]", "}", "token = get()", "const secret = 1", "var credential int", "password := read()", "console.log(secret)", "fmt.Println(password)", "logger.info(token)",
    'let s = "abcdefghijklmnopqrst";', "let t = 'aaaaaaaaaaaaaaaa';", "import left", "from pad import right", "left(1)", "", "import { aa, bb as cc } from 'm'", "import Dd from 'n'",
    "if true {", "{}", "fn empty()", "let _ = go();", "#[allow(dead_code)]", "def typed(a: int, self) -> str:", "async def plain(self):", "function named(a) {", "// @param a", "function sum(b: number): void {",
    '"""Docstring."""', "# note", "func Test_it(b []byte) {", "func read(s string, n int) {", "proptest!(run, total_sum)", "@given(x)", "def test_one(data: bytes):", "fc.assert(property(x => const q =", "class Thing:", "type Box struct {",
    "use crate::store::open;", "use serde::Value;", "use super::*;", 'import "fmt"', "w.wrapping_add(1) << 2", "if a < b { c >= d }", "fuzz_target!(|d| run(d));",
)
COUNT, STEP = 26, len(FLOW_LINES)
FLOW_EXTENSIONS = ("rs", "py", "js", "ts", "go")


def tree(spark, sf_dir):
    p = F.col("p_partkey")
    table, ext = F.array(*[F.lit(t) for t in FLOW_LINES]), F.array(*[F.lit(e) for e in FLOW_EXTENSIONS])
    content = F.transform(F.sequence(F.lit(0), F.lit(COUNT - 1)), lambda j: F.element_at(table, (F.pmod(p * (j * 2 + 1) + j * j, F.lit(STEP)) + 1).cast("int")))
    name = F.concat(F.when(p % 9 == 0, "fuzz/t_").otherwise("src/flow_"), p.cast("string"), F.lit("."), F.element_at(ext, (F.pmod(p, F.lit(len(FLOW_EXTENSIONS))) + 1).cast("int")))
    return parts(spark, sf_dir).select(name.alias("path"), F.concat_ws("\n", content).alias("content"))


FILES = f"""files AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'fuzz/t_' ELSE 'src/flow_' END || p_partkey || '.' || ({list(FLOW_EXTENSIONS)!r})[1 + p_partkey % {len(FLOW_EXTENSIONS)}] AS path,
    array_to_string([([{', '.join(map(text, FLOW_LINES))}])[1 + (p_partkey * (2 * j + 1) + j * j) % {STEP}] FOR j IN range({COUNT})], chr(10)) AS content FROM part)"""
HEAD = f"WITH {FILES}, {LINES}"
W = r"[\p{L}\p{N}_]"


def contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def starts_any(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {text(w)})" for w in words) + ")"


def sink_case(language: str) -> str:
    return "CASE " + " ".join(f"WHEN {contains_any('trimmed', w) if w else 'starts_with(trimmed, ' + text('pub fn') + ')'} THEN '{k}'" for k, w in flows.SINKS[language]) + " END"


def before(event: str, of: str = "lines") -> str:
    return f"coalesce(last_value({event} IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"


@register("taint", rf"""{HEAD}, a AS (SELECT *, {before("CASE WHEN ext = 'rs' AND starts_with(trimmed, '#[test]') THEN true WHEN starts_with(trimmed, '}') THEN false END")} AS in_test, ext = 'rs' AND starts_with(trimmed, '#[test]') AS begins,
        contains(trimmed, '@sensitive') OR (ext = 'rs' AND starts_with(trimmed, '#[sensitive')) AS marker FROM lines),
    m AS (SELECT *, {before("CASE WHEN NOT in_test AND NOT begins AND trimmed <> '' THEN marker END")} AS marked, in_test OR begins OR marker AS skipped FROM a),
    k AS (SELECT *, CASE WHEN skipped THEN '' WHEN ext = 'rs' THEN regexp_extract(trimmed, '^(?:let|const|static)\s+(?:mut )?({W}+)(?:[^\p{{L}}\p{{N}}_])', 1) WHEN ext = 'py' THEN regexp_extract(trimmed, '^({W}+)\s*=', 1)
        WHEN ext IN ('js', 'ts') THEN regexp_extract(trimmed, '^(?:const|let|var) ([^=:; ]+)', 1) WHEN regexp_extract(trimmed, '^var \s*(\S+)', 1) <> '' THEN regexp_extract(trimmed, '^var \s*(\S+)', 1) ELSE regexp_extract(trimmed, '^([^,]*[^,\s])\s*:=', 1) END AS name,
        CASE WHEN skipped THEN NULL WHEN ext = 'rs' THEN {sink_case('rust')} WHEN ext = 'py' THEN {sink_case('python')} WHEN ext = 'go' THEN {sink_case('go')} ELSE {sink_case('script')} END AS kind FROM m),
    f AS (SELECT *, name <> '' AND ({contains_any('lower(name)', flows.SENSITIVE)} OR marked OR contains(trimmed, 'Secret::')) AS defines FROM k),
    s AS (SELECT path, name, min(line) AS since FROM f WHERE defines GROUP BY 1, 2)
    SELECT f.path AS file, line, s.name AS variable, kind, CASE WHEN kind IN ('LOG_LEAK', 'PRINT_LEAK') THEN 'high' WHEN kind = 'DEBUG_LEAK' THEN 'low' ELSE 'medium' END AS severity
    FROM f JOIN s ON f.path = s.path AND line > since AND contains(text, s.name) WHERE NOT defines AND kind IS NOT NULL""")
def taint(spark, sf_dir):
    return flows.taint(tree(spark, sf_dir))


TIMES = "(length(content) - length(replace(content, name, ''))) / length(name) <= 1"


@register("dead_code", rf"""{HEAD}, p AS (SELECT *, coalesce(last_value(CASE WHEN trimmed <> '' THEN trimmed END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS previous FROM lines),
    i AS (SELECT path, line, regexp_replace(regexp_extract(trimmed, '^(?:from .*? import|import)\s+([^\s,]+)', 1), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') AS name FROM lines WHERE ext = 'py' AND {starts_any('trimmed', 'import ', 'from ')}
      UNION ALL SELECT path, line, name FROM (SELECT path, line, unnest(CASE WHEN contains(trimmed, '{{') THEN list_transform(string_split(regexp_extract(trimmed, '\{{([^}}]*)\}}', 1), ','), lambda x: trim(regexp_replace(trim(x), ' as .*$', '')))
        ELSE [regexp_replace(regexp_extract(trimmed, '^import\s+(\S+)', 1), '^\*+|\*+$', '', 'g')] END) AS name FROM lines WHERE ext IN ('js', 'ts') AND starts_with(trimmed, 'import ') AND contains(trimmed, 'from ')) WHERE name <> '')
    SELECT i.path AS file, line, 'unused_import' AS kind, 'low' AS severity FROM i JOIN files USING (path) WHERE {TIMES} AND name <> ''
    UNION ALL SELECT path, line, 'allow_dead_code', 'medium' FROM lines WHERE contains(trimmed, '#[allow(dead_code)]') OR contains(trimmed, '# noqa: F401')
    UNION ALL SELECT path, line, 'unreachable_branch', CASE WHEN contains(trimmed, 'true') THEN 'medium' ELSE 'high' END FROM lines WHERE trimmed IN ('if false {{', 'if (false) {{', 'if true {{', 'if (true) {{')
    UNION ALL SELECT path, line, 'dead_assignment', 'low' FROM lines WHERE ext = 'rs' AND {starts_any('trimmed', 'let _ =', 'let _x =')}
    UNION ALL SELECT path, line, 'empty_block', 'low' FROM p WHERE trimmed IN ('{{}}', '{{ }}') AND ({contains_any('previous', ('fn ', 'def ', 'function '))} OR ends_with(previous, 'else') OR ends_with(previous, 'else {{'))""")
def dead_code(spark, sf_dir):
    return flows.dead_code(tree(spark, sf_dir))


# --- secrets and routes -------------------------------------------------------------------------

SECRET_LINES = (
    'password = "hunter22"', 'password = "password";', "api_key: abcd", "secret_key =", "let token = Token::new();", 'auth_token = "Hardcoded values are never good to have here"', "# password = x", 'db_password = "example"',
    'x = "AbCdEfGhIjKlMnOpQrStUvWxYz01"', "y = 'AbCdEfGhIjKlM\\'NOPQRSTUVW'", 'z = "<div><span>AbCdEfGhIjKlMnOpQr"', 'f = "{} AbCdEfGhIjKlMnOpQrStUv"', 'open = "AbCdEfGhIjKlMnOpQrStUvé', 'jdbc:h2 = "short"',
    "app.get('/a', handler)", "router.get('/b', auth, handler)", "app.get('/health', h)", "@app.route('/c')", "r.GET('/d', f(1, 2, 3))", "router.get(f(a, b), g('x, y', 2), h)", "pattern: app.get('/e')", "description: password = 1",
    "(\"password_assign\", 1)", "env::var(api_key = std)", '"""', "value", "passwd = 'passwd'", 'bearer "abcdefghijkl" + "AaBbCcDdEeFfGgHh1122"',
)
SECRET_EXTENSIONS = ("py", "js", "rs")


def secret_files(spark, sf_dir, extra=()):
    p, table = F.col("p_partkey"), F.array(*[F.lit(t) for t in (*SECRET_LINES, *extra)])
    n = len(SECRET_LINES) + len(extra)
    content = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.element_at(table, (F.pmod(p * (j * 2 + 1) + j, F.lit(n)) + 1).cast("int")))
    ext = F.element_at(F.array(*[F.lit(e) for e in SECRET_EXTENSIONS]), (F.pmod(p, F.lit(3)) + 1).cast("int"))
    return parts(spark, sf_dir).select(F.concat(F.lit("app/k_"), p.cast("string"), F.lit("."), ext).alias("path"), F.concat_ws("\n", content).alias("content"))


def secret_head(extra=()) -> str:
    return f"""WITH files AS (SELECT 'app/k_' || p_partkey || '.' || ({list(SECRET_EXTENSIONS)!r})[1 + p_partkey % 3] AS path,
    array_to_string([([{', '.join(map(text, (*SECRET_LINES, *extra)))}])[1 + (p_partkey * (2 * j + 1) + j) % {len(SECRET_LINES) + len(extra)}] FOR j IN range(12)], chr(10)) AS content FROM part), {LINES}"""


S = secret_rules
KEYS = among(S.KEYWORDS)
DOUBLE = S.LITERAL.replace('\\"', '"').replace("'", "''")


@register("secrets", rf"""{secret_head()}, live AS (SELECT * FROM lines WHERE NOT {contains_any('lower(text)', S.EXAMPLES)} AND NOT regexp_matches(trimmed, '^(//|#|\*)')),
    v AS (SELECT *, trim(CASE WHEN contains(text, '=') THEN regexp_extract(text, '^[^=]*=(.*)$', 1) ELSE regexp_extract(text, '^[^:]*:(.*)$', 1) END, ' ' || chr(9) || chr(13)) AS value FROM live WHERE (contains(text, '=') OR contains(text, ':'))
        AND NOT {contains_any('lower(text)', S.DESCRIPTIONS)} AND NOT (starts_with(trimmed, '("') AND contains(trimmed, '_assign'))),
    k AS (SELECT *, regexp_replace(value, '^[";,]+|[";,]+$', '', 'g') AS inside, {case(rule_tables.SECRETS, 'lower(text)', 'id')} AS pattern, {case(rule_tables.SECRETS, 'lower(text)', 'severity')} AS severity FROM v),
    l AS (SELECT path, line, unnest(list_transform(list_zip(regexp_extract_all(text, '{DOUBLE}', 1), regexp_extract_all(text, '{DOUBLE}', 2)), lambda x: regexp_replace(coalesce(x[1], '') || coalesce(x[2], ''), '\\.?', '', 'g'))) AS lit FROM live),
    e AS (SELECT *, round(list_aggregate(regexp_extract_all(hex(encode(lit)), '..'), 'entropy'), 6) AS entropy FROM l WHERE strlen(lit) >= 12 AND {' + '.join(f'contains(lower(lit), {text(m)})::INT' for m in S.MARKUP)} < 2
        AND NOT {contains_any('lower(lit)', S.CODE)} AND NOT {contains_any('lit', S.FORMATS)} AND NOT (strlen(lit) > 100 AND {contains_any('lower(lit)', S.COMMON_WORDS)} AND {contains_any('lit', S.PUNCTUATION)}))
    SELECT path AS file, line, 'pattern' AS kind, pattern, severity, NULL::DOUBLE AS entropy FROM k WHERE pattern IS NOT NULL AND value <> '' AND lower(value) NOT IN {KEYS} AND NOT (regexp_matches(value, '^["'']') AND lower(inside) IN {KEYS})
        AND NOT (starts_with(value, '"') AND strlen(value) > 40 AND {starts_any('inside', *S.PROSE)})
    UNION ALL SELECT path, line, 'entropy', 'high_entropy_string', CASE WHEN entropy >= 5.5 THEN 'high' ELSE 'medium' END, entropy FROM e WHERE entropy >= 4.0""")
def secrets(spark, sf_dir):
    return secret_rules.secrets(corpus.lines(secret_files(spark, sf_dir)), 4.0)


AUTH_RULES = [r for r in rule_tables.ACCESS_CONTROL if r.category == "missing_auth"]


def inline_sql(column: str) -> str:
    hits = [f"contains({column}, '@UseGuards(')", f"(contains({column}, 'route_layer(') AND contains(lower({column}), 'auth'))"]
    for m in rule_tables.ROUTE_METHODS:
        plain = f"regexp_replace(regexp_extract(lower({column}), '^.*?{m[:-1]}\\((.*)$', 1), '\"[^\"]*(\"|$)|''[^'']*(''|$)', '', 'g')"
        for _ in range(scans.NESTED):
            plain = f"regexp_replace({plain}, '\\([^()]*\\)', '', 'g')"
        hits.append(f"len(string_split(regexp_replace(regexp_extract({plain}, '^([^)]*)', 1), '\\(.*$', ''), ',')) > 2")
    return "(" + " OR ".join(hits) + ")"


ROUTES = """, events AS (SELECT *, CASE WHEN starts_with(trimmed, '/*') AND NOT contains(trimmed, '*/') THEN 1 WHEN contains(trimmed, '*/') THEN 0 END AS event FROM lines),
    c AS (SELECT coalesce(bool_or({auth} AND NOT starts_with(trimmed, '//')), false) AS auth FROM lines),
    live AS (SELECT *, {n} AS rule FROM lines, c WHERE NOT regexp_matches(trimmed, '^(//|--|<!--|;|%)') AND NOT (starts_with(trimmed, '#') AND NOT regexp_matches(trimmed, '^#[\\[!#]'))
        AND NOT (ext = 'py' AND starts_with(trimmed, '\"\"\"')) AND NOT regexp_matches(trimmed, '^(pattern|description|remediation|rule_id|severity|also):')),
    r AS (SELECT *, CASE WHEN rule IS NOT NULL AND NOT auth AND NOT {public} AND NOT {inline} THEN rule END AS route, {literal} AS other FROM live)
    SELECT path AS file, line, coalesce(route, other) AS rule_id FROM r WHERE coalesce(route, other) IS NOT NULL""".format(
    auth=contains_any("text", rule_tables.AUTH_MIDDLEWARE), n=case(AUTH_RULES, "text", "id"), public=contains_any("lower(text)", rule_tables.PUBLIC_ROUTES), inline=inline_sql("text"), literal=case(scans.LITERAL_ACCESS, "text", "id")
)


def routes(spark, sf_dir, extra=()):
    lines = corpus.lines(secret_files(spark, sf_dir, extra))
    return scans.access_control(lines, scans.app_wide_auth(lines)).select("file", "line", "rule_id")


@register("missing_auth", secret_head() + ROUTES)
def missing_auth(spark, sf_dir):
    return routes(spark, sf_dir)


@register("routes_behind_middleware", secret_head(("router.Use(auth)",)) + ROUTES)
def routes_behind_middleware(spark, sf_dir):
    return routes(spark, sf_dir, ("router.Use(auth)",))


# --- mutants ------------------------------------------------------------------------------------


def mutant_rows() -> str:
    rows = []
    for kind, swaps in flows.SWAPS.items():
        for old, new in swaps:
            unless = flows.UNLESS.get((kind, old), "\x01")
            first = "true" if kind == "boundary" else "false"
            rows.append(f"({text(kind)}, {text(old)}, {text(new)}, {text(unless)}, {first})")
    return ", ".join(rows)


CALL_ROWS = ", ".join(f"({text(c)})" for c in flows.CALLS)
MUTANTS = f"""m AS (SELECT path AS file, line, category, original, CASE WHEN first THEN substr(text, 1, strpos(text, original) - 1) || new || substr(text, strpos(text, original) + length(original)) ELSE replace(text, original, new) END AS mutated
      FROM lines, (VALUES {mutant_rows()}) s(category, original, new, unless, first) WHERE NOT starts_with(trimmed, '//') AND contains(text, original) AND NOT contains(text, unless)
    UNION ALL SELECT path, line, 'arithmetic', original, replace(replace(text, '.' || original || '(', '.'), original || '(', '( ') FROM lines, (VALUES {CALL_ROWS}) s(original) WHERE NOT starts_with(trimmed, '//') AND contains(text, original))"""


@register("mutants", f"{HEAD}, {MUTANTS} SELECT * FROM m")
def mutants(spark, sf_dir):
    return flows.mutants(corpus.lines(tree(spark, sf_dir)))


@register("limited_mutants", f"{HEAD}, {MUTANTS}, r AS (SELECT *, row_number() OVER (ORDER BY file, category, original, line) AS n FROM m) SELECT file, line, category, original, mutated FROM r WHERE n <= 120")
def limited_mutants(spark, sf_dir):
    return flows.limited(flows.mutants(corpus.lines(tree(spark, sf_dir))), 120)


@register("mutation_score", f"""{HEAD}, {MUTANTS} SELECT file, count(*) FILTER ((line + length(original)) % 3 = 0) AS killed, count(*) AS total, round(count(*) FILTER ((line + length(original)) % 3 = 0) * 100.0 / count(*), 6)::DOUBLE AS score FROM m GROUP BY file""")
def mutation_score(spark, sf_dir):
    found = flows.mutants(corpus.lines(tree(spark, sf_dir)))
    return flows.mutation_score(found.withColumn("status", F.when((F.col("line") + F.length("original")) % 3 == 0, "killed").otherwise("survived")))


# --- what functions declare ---------------------------------------------------------------------

ANNOTATED = "len(list_filter(string_split({p}, ','), lambda x: trim(x) <> '' AND trim(x) NOT IN ({but}) AND contains(x, ':'))) > 0"
LAST, NEXT = r"regexp_extract(trimmed, '\((.*)\)', 1)", r"regexp_extract(trimmed, '\(([^)]*)\)', 1)"
ABOVE = "list(trimmed) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS above"


@register("type_coverage", rf"""{HEAD}, a AS (SELECT *, {ABOVE.format(n=5)} FROM lines),
    k AS (SELECT *, CASE WHEN ext = 'py' AND {starts_any('trimmed', 'def ', 'async def ')} THEN 'Python' WHEN ext = 'ts' AND ({starts_any('trimmed', 'function ', 'async function ')} OR (contains(trimmed, '): ') AND ({starts_any('trimmed', 'public ', 'private ', 'protected ')} OR {contains_any('trimmed', ('=> {', '=> ('))}))) THEN 'TypeScript'
        WHEN ext = 'js' AND {starts_any('trimmed', 'function ', 'async function ')} THEN 'JavaScript' END AS language FROM a),
    t AS (SELECT path, language, CASE language WHEN 'Python' THEN (contains(trimmed, '->') AND NOT ends_with(trimmed, '-> None:')) OR {ANNOTATED.format(p=LAST, but="'self', 'cls'")}
        WHEN 'TypeScript' THEN {ANNOTATED.format(p=NEXT, but="'...'")} OR (contains(trimmed, '): ') AND NOT ends_with(trimmed, '): void {{')) OR contains(trimmed, '): void')
        ELSE len(list_filter(coalesce(above, []), lambda x: {contains_any('x', ('@param', '@returns', '@type'))})) > 0 END AS typed FROM k WHERE language IS NOT NULL)
    SELECT path AS file, language, count(*) AS total, count(*) FILTER (typed) AS covered, round(count(*) FILTER (typed) * 100.0 / count(*), 6)::DOUBLE AS pct, round(count(*) FILTER (typed) * 100.0 / count(*), 6) < 50 AS below FROM t GROUP BY 1, 2""")
def type_coverage(spark, sf_dir):
    return surface.coverage(surface.typed_functions(corpus.lines(tree(spark, sf_dir), "above")), ["file", "language"], "typed", 50.0)


PUBLIC_CASE = "CASE " + " ".join(f"WHEN ext = '{e}' THEN regexp_extract(trimmed, '{p}', 1)" for e, p in surface.PUBLIC.items()) + " END"
DOC_CASE = "CASE " + " ".join(f"WHEN ext = '{e}' THEN len(list_filter(coalesce(above, []), lambda x: {starts_any('x', *p)})) > 0" + (" OR regexp_matches(after, '^[rRbBuU]?[\"'']')" if e == "py" else "") for e, p in surface.DOCUMENTATION.items()) + " END"
DOC_ITEMS = f"""{HEAD}, a AS (SELECT *, {ABOVE.format(n=4)}, lead(trimmed, 1, '') OVER (PARTITION BY path ORDER BY line) AS after FROM lines),
    d AS (SELECT path AS file, line, {PUBLIC_CASE} AS kind, {DOC_CASE} AS documented FROM a)"""


@register("documented_items", f"{DOC_ITEMS} SELECT * FROM d WHERE kind <> ''")
def documented_items(spark, sf_dir):
    return surface.documented_items(corpus.lines(tree(spark, sf_dir), "above", "after"))


@register("documentation_check", f"""{DOC_ITEMS}, n AS (SELECT count(*) AS total, count(*) FILTER (documented) AS covered FROM d WHERE kind <> ''), p AS (SELECT *, round(covered * 100.0 / total, 6)::DOUBLE AS pct FROM n)
    SELECT *, pct >= 80 AS passed, CASE WHEN pct >= 80 THEN 'doccov-pass' WHEN pct < 40 THEN 'doccov-low' ELSE 'doccov-moderate' END AS rule_id, CASE WHEN pct >= 80 THEN 'info' WHEN pct < 40 THEN 'error' ELSE 'warning' END AS severity FROM p""")
def documentation_check(spark, sf_dir):
    return surface.documentation_check(surface.documented_items(corpus.lines(tree(spark, sf_dir), "above", "after")))


@register("property_coverage", rf"""{HEAD}, a AS (SELECT *, lead(trimmed, 1, '') OVER (PARTITION BY path ORDER BY line) AS after FROM lines),
    s AS (SELECT *, CASE WHEN starts_with(trimmed, 'function ') THEN regexp_extract(trimmed, '^function ([^(\s]+)', 1) WHEN contains(trimmed, 'const ') AND contains(trimmed, '=>') THEN regexp_extract(trimmed, 'const ([^=\s]+)', 1) ELSE '' END AS script_fn,
        CASE WHEN lower(regexp_extract(trimmed, '^.*?fn ([^(\s]+)[(\s]', 1)) IN {among(surface.NOT_NAMES)} THEN '' ELSE regexp_extract(trimmed, '^.*?fn ([^(\s]+)[(\s]', 1) END AS rust_fn FROM a),
    f AS (SELECT path, ext, CASE WHEN ext = 'rs' AND {starts_any('trimmed', 'fn ', 'pub fn ')} THEN rust_fn WHEN ext = 'py' AND starts_with(trimmed, 'def ') THEN regexp_extract(trimmed, '^def ([^(\s]+)', 1) WHEN ext IN ('js', 'ts') THEN script_fn
        WHEN ext = 'go' AND starts_with(trimmed, 'func ') THEN regexp_extract(trimmed, '^func ([^(\s]+)', 1) ELSE '' END AS name,
        (ext = 'rs' AND (starts_with(trimmed, '#[test]') OR contains(trimmed, '# [ test ]'))) OR (ext = 'py' AND {starts_any('trimmed', 'def test_', 'async def test_')}) OR (ext = 'go' AND starts_with(trimmed, 'func Test')) AS unit,
        CASE WHEN ext = 'rs' AND {contains_any('trimmed', ('proptest!', 'quickcheck!', '#[quickcheck]', '# [ quickcheck ]'))} THEN list_filter(regexp_extract_all(text, '([\p{{L}}\p{{N}}_]+)', 1), lambda x: strlen(x) > 3 AND lower(x) NOT IN {among(surface.NOT_NAMES)})
          WHEN ext = 'rs' AND starts_with(trimmed, 'fn ') AND contains(trimmed, 'prop') THEN [rust_fn] WHEN ext = 'py' AND {contains_any('trimmed', ('@given', '@hypothesis.given'))} THEN [regexp_extract(after, '^def ([^(\s]+)', 1)]
          WHEN ext IN ('js', 'ts') AND {contains_any('trimmed', ('fc.assert', 'fastCheck', 'property('))} AND script_fn <> '' THEN [CASE WHEN contains(trimmed, 'function ') THEN regexp_extract(trimmed, 'function ([^(\s]+)', 1) WHEN contains(trimmed, 'const ') AND contains(trimmed, '=') THEN regexp_extract(trimmed, 'const ([^=\s]+)', 1) ELSE '' END] ELSE [] END AS tested FROM s),
    u AS (SELECT path, bool_or(unit) AS any_unit FROM f GROUP BY 1), t AS (SELECT DISTINCT path, unnest(tested) AS name FROM f)
    SELECT f.name, bool_or(t.name IS NOT NULL) AS property_tested, bool_or(CASE WHEN ext = 'rs' THEN any_unit ELSE unit END) AS unit_tested FROM f JOIN u USING (path) LEFT JOIN t ON t.path = f.path AND t.name = f.name WHERE f.name <> '' GROUP BY 1""")
def property_coverage(spark, sf_dir):
    return surface.property_coverage(corpus.lines(tree(spark, sf_dir), "after"))


def worth_sql(ext: str) -> str:
    grades = " ".join(f"WHEN {contains_any('lower(x)', words)} THEN {points}" for points, words in surface.FUZZED[ext])
    return f"coalesce(list_sum(list_transform(ps, lambda x: CASE {grades} ELSE 0 END)), 0)"


@register("fuzz_surface", rf"""{HEAD}, h AS (SELECT DISTINCT unnest(regexp_extract_all(text, '([\p{{L}}\p{{N}}_]+)', 1)) AS name FROM lines WHERE regexp_matches(path, '(^|/)fuzz/[^/]*\.rs$') AND contains(text, 'fuzz_target!')),
    g AS (SELECT path, line, trimmed, CASE WHEN ext = 'ts' THEN 'js' ELSE ext END AS kind, CASE WHEN regexp_extract(trimmed, '\((.*)\)', 1) = '' THEN [] ELSE string_split(regexp_extract(trimmed, '\((.*)\)', 1), ',') END AS ps FROM lines WHERE NOT {starts_any('trimmed', '//', '#', '/*', '[', '@', '*')}),
    n AS (SELECT *, CASE kind {' '.join(f"WHEN '{e}' THEN regexp_extract(trimmed, '{p}', 1)" for e, p in surface.HEADS.items())} END AS name, CASE kind {' '.join(f"WHEN '{e}' THEN {worth_sql(e)}" for e in surface.FUZZED)} END AS worth FROM g),
    c AS (SELECT path, name, 1 + min(line) % 13 AS complexity FROM n WHERE name <> '' AND line % 2 = 0 GROUP BY 1, 2)
    SELECT n.path AS file, line, name, (worth + CASE WHEN kind = 'rs' AND starts_with(trimmed, 'pub ') THEN 10 ELSE 0 END + 2 * len(ps) - CASE WHEN kind = 'rs' AND h.name IS NOT NULL THEN 5 ELSE 0 END)::INT AS score,
        CASE kind WHEN 'rs' THEN starts_with(trimmed, 'pub ') WHEN 'py' THEN NOT starts_with(name, '_') WHEN 'go' THEN regexp_matches(name, '^\p{{Lu}}') ELSE true END AS public, coalesce(c.complexity, 10)::INT AS complexity, kind = 'rs' AND h.name IS NOT NULL AS harnessed
    FROM n LEFT JOIN h USING (name) LEFT JOIN c USING (path, name) WHERE name <> '' AND worth > 0""")
def fuzz_surface(spark, sf_dir):
    lines = corpus.lines(tree(spark, sf_dir))
    heads = lines.withColumn("ext", corpus.extension(F.col("path"))).withColumn("kind", F.when(F.col("ext") == "ts", "js").otherwise(F.col("ext")))
    name = F
    for e, p in surface.HEADS.items():
        name = name.when(F.col("kind") == e, F.regexp_extract("trimmed", p, 1))
    known = heads.filter("line % 2 = 0 and not (trimmed like '//%' or trimmed like '#%' or trimmed like '@%')").select(F.col("path").alias("file"), name.alias("name"), "line", (1 + F.col("line") % 13).alias("complexity")).filter("name <> ''")
    return surface.fuzz_surface(lines, surface.harness_names(lines), known)


# --- imports ------------------------------------------------------------------------------------


@register("imports", rf"""{HEAD} SELECT path AS file, line, module FROM (SELECT path, line, ext, CASE WHEN ext = 'rs' AND starts_with(trimmed, 'use ') THEN trim(regexp_replace(trimmed[5:], ';+$', '')) WHEN ext = 'py' AND starts_with(trimmed, 'from ') THEN regexp_extract(trimmed, '^from (\S+) import ', 1)
        WHEN ext = 'py' AND starts_with(trimmed, 'import ') THEN regexp_extract(trimmed, '^import ([^\s,;]+)', 1) WHEN ext IN ('js', 'ts') AND starts_with(trimmed, 'import ') THEN regexp_extract(trimmed, '["'']([^"'']*)["'']', 1) WHEN ext = 'go' AND regexp_matches(trimmed, '^(?:import )?(?:\w+ )?"[^"]*"$') THEN regexp_extract(trimmed, '"([^"]*)"', 1) END AS module FROM lines)
    WHERE module <> '' AND NOT ends_with(module, '::*') AND (ext <> 'rs' OR regexp_matches(module, '^(crate|self|super)::') OR NOT contains(module, '::'))""")
def import_edges(spark, sf_dir):
    found = imports.imports(corpus.lines(tree(spark, sf_dir)))
    return found.filter(metrics.workspace_import(F.col("module"), F.col("file").endswith(".rs")))


@register("average_fan_out", "WITH e AS (SELECT DISTINCT 'm' || l_suppkey % 97 AS src, 'm' || l_partkey % 89 AS dst FROM lineitem), m AS (SELECT src AS x FROM e UNION SELECT dst FROM e) SELECT round((SELECT count(*) FROM e) / (SELECT count(*) FROM m), 6) AS average")
def average_fan_out(spark, sf_dir):
    return metrics.average_fan_out(coupling(spark, sf_dir))


@register("structured_logging", f"WITH {CODE_FILES} SELECT count(*) AS files, count(*) FILTER ({contains_any('content', rule_tables.LOG_IMPORTS)}) AS structured FROM files WHERE NOT contains(path, 'test') AND NOT contains(path, 'spec')")
def structured_logging(spark, sf_dir):
    return scans.structured_logging(corpus.code(spark, sf_dir))


@register("long_functions", "SELECT 's' || c_custkey AS file, 'fn' || k AS name, k * 25 AS line, k * 25 + (c_custkey % 60) AS end_line, c_custkey % 60 + 1 AS n_lines FROM customer, range(0, 3) t(k) WHERE c_custkey % 60 + 1 > 40")
def long_functions(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return metrics.long_functions(c.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("file"), F.concat(F.lit("fn"), F.col("k").cast("string")).alias("name"), (F.col("k") * 25).cast("long").alias("line"), (F.col("k") * 25 + F.col("c_custkey") % 60).alias("end_line")))


MARKED = ("# TODO: tidy (up)", 's = "TODO: not this"', 's = "a" // FIXME(x): y */', "HACK without", 's = \\" BUG: in', "XXX: z", 't = "x \\" WARN: still inside"')


@register("debt_items", f"""WITH l AS (SELECT p_partkey AS line, ([{', '.join(map(text, MARKED))}])[1 + p_partkey % {len(MARKED)}] AS t FROM part)
    SELECT 'a.rs' AS file, line, CASE line % {len(MARKED)} WHEN 0 THEN 'todo' WHEN 2 THEN 'fixme' WHEN 3 THEN 'hack' WHEN 4 THEN 'bug' WHEN 5 THEN 'xxx' END AS type, CASE line % {len(MARKED)} WHEN 0 THEN 'tidy (up' WHEN 2 THEN 'x): y' WHEN 3 THEN 'without' WHEN 4 THEN 'in' WHEN 5 THEN 'z' END AS text FROM l WHERE line % {len(MARKED)} NOT IN (1, 6)""")
def debt_items(spark, sf_dir):
    t = F.element_at(F.array(*[F.lit(m) for m in MARKED]), (F.pmod("p_partkey", F.lit(len(MARKED))) + 1).cast("int"))
    return scans.debt_items(read(spark, sf_dir, "part").select(F.lit("a.rs").alias("path"), F.col("p_partkey").alias("line"), t.alias("text"), t.alias("trimmed")))


GLOBS = {"src/**": "source", "src/unit_1*.rs": "ones", "tests/**": "tests"}


@register("path_overrides", f"WITH {CODE_FILES} SELECT CASE " + " ".join(f"WHEN regexp_matches(path, '{flows.glob_pattern(g)}') THEN '{GLOBS[g]}'" for g in sorted(GLOBS, key=lambda g: (-len(g), g))) + " END AS override, count(*) AS n FROM files GROUP BY 1")
def path_overrides(spark, sf_dir):
    return flows.override(corpus.code(spark, sf_dir), GLOBS).groupBy("override").agg(F.count(F.lit(1)).alias("n"))


@register("coverage_hits", "SELECT 'fn' || o_custkey AS function, min(o_orderkey % 100)::INT AS line, sum(o_orderkey % 5)::BIGINT AS hits FROM orders GROUP BY 1")
def coverage_hits(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    name = F.concat(F.lit("fn"), F.col("o_custkey").cast("string"))
    fn = F.concat(F.lit("FN:"), (F.col("o_orderkey") % 100).cast("string"), F.lit(","), name)
    hit = F.concat(F.lit("FNDA:"), (F.col("o_orderkey") % 5).cast("string"), F.lit(","), name)
    return corpus.lcov(o.select(F.explode(F.array(fn, hit)).alias("value")))
