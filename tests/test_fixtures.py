"""Operators on hand-made inputs with values computed by hand."""

import json
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.operators import checks, flows, grammar, graphs, halstead, imports, metrics, parse, scans, secret_rules, surface
from quillwork.sources import corpus, history, line_state, packages, reports
from quillwork.streaming import watch


def files(spark, **named):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v) for k, v in named.items()], "path string, content string")


def one(spark, path, content):
    return spark.createDataFrame([(path, content)], "path string, content string")


def lines(spark, path, content, *states):
    return corpus.lines(one(spark, path, content), *states)


def test_lines_around_against_windows(spark):
    """The lines before and after within a file are those that a window over its lines finds."""
    import random

    pick = random.Random(4)
    rows = [(f"f{i}.rs", "\n".join(pick.choice(["", "x", "  y  ", "let a;", "}"]) for _ in range(pick.randint(0, 25)))) for i in range(60)]
    df = spark.createDataFrame([*rows, ("n.rs", None), ("e.rs", "")], "path string, content string")
    keys = ["path", "line", "text", "trimmed", "before", "after"]
    assert sorted(map(tuple, corpus.lines(df, "before", "after").select(keys).collect())) == sorted(map(tuple, scans.knowing(corpus.lines(df), "before", "after").select(keys).collect()))


def test_block_comments_and_tests_against_a_walk(spark):
    import random

    pick = random.Random(9)
    pool = ["eval(x)", "/* a", "*/", "/* b */ eval(y)", "z", "x.unwrap()", "#[cfg(test)]", "// eval(q)"]
    rows = [(f"f{i}.rs", "\n".join(pick.choice(pool) for _ in range(pick.randint(0, 25)))) for i in range(80)]
    evals, unwraps = set(), set()
    for path, content in rows:
        inside = tests = False
        for n, line in enumerate(content.split("\n") if content else [], 1):
            tests = tests or line == "#[cfg(test)]"
            if line == "x.unwrap()" and not tests:
                unwraps.add((path, n))
            if inside:
                inside = "*/" not in line
            elif line.startswith("/*"):
                inside = "*/" not in line
            elif line == "eval(x)":
                evals.add((path, n))
    df = corpus.lines(spark.createDataFrame(rows, "path string, content string"))
    assert {(r.file, r.line) for r in scans.sast(df).collect()} == evals and {(r.file, r.line) for r in scans.error_handling(df).collect()} == unwraps


def test_running_states(spark):
    text = "[package]\nname\n\n#[test]\nfn a() {\n}\n// @sensitive\n\nlet b;\n[[package]]\nv"
    got = line_state.lines(one(spark, "a.rs", text), "previous", "in_test", "marked", "section", "package", "above").orderBy("line").collect()
    assert [r.previous for r in got] == ["", "[package]", "name", "name", "#[test]", "fn a() {", "}", "// @sensitive", "// @sensitive", "let b;", "[[package]]"]
    assert [r.line for r in got if r.in_test] == [5, 6] and [r.line for r in got if r.marked] == [8, 9]
    assert got[8].section == "[package]" and got[10].section == "[[package]]" and got[10].package == 10 and got[9].package == 0
    assert got[6].above == ["name", "", "#[test]", "fn a() {", "}"]


@pytest.mark.parametrize("content, want", [
    ("// @sensitive\nlet x = make();\nlog::info!(x);", [(3, "x", "LOG_LEAK", "high")]),
    ("let k = Secret::new();\nprintln!(k);", [(2, "k", "PRINT_LEAK", "high")]),
    ("let password = 1;\nhash(password);", []),
    ("let plain = 1;\nprintln!(plain);", []),
    ("#[sensitive]\n\n\nlet x = 1;\ndbg!(x);\nstd::fs::OpenOptions::new(x);", [(5, "x", "DEBUG_LEAK", "low"), (6, "x", "FILE_WRITE", "medium")]),
    ("// @sensitive\nother();\nlet x = 1;\nprintln!(x);", []),
    ("#[test]\nfn t() {\nlet token = 1;\nprintln!(token);\n}\nprintln!(token);", []),
    ("let token = 1;\nlet b = println!(token);", [(2, "token", "PRINT_LEAK", "high")]),
    ("let token = 1;\n// @sensitive println!(token)", []),
])
def test_taint_of_rust(spark, content, want):
    assert sorted((r.line, r.variable, r.kind, r.severity) for r in flows.taint(one(spark, "a.rs", content)).collect()) == want


def test_taint_of_other_languages(spark):
    df = files(spark, a_dot_py="password = get()\nlogger.info(password)\nif password == 1: print(password)", b_dot_ts="const apiKey = 1\nlet api_key = f()\nconsole.debug(api_key)", c_dot_go="a, token := f()\nvar secret string\nfmt.Printf(secret)")
    assert sorted((r.file, r.line, r.variable, r.kind) for r in flows.taint(df).collect()) == [("a.py", 2, "password", "LOG_LEAK"), ("a.py", 3, "password", "PRINT_LEAK"), ("b.ts", 3, "api_key", "DEBUG_LEAK"), ("c.go", 3, "secret", "PRINT_LEAK")]


@pytest.mark.parametrize("line, found", [
    ('password = "hunter22"', True), ('password = "password"', False), ("password =", False), ("// password = 1", False), ('your_password = "x1"', False), ("x password", False),
    ('password: "Hardcoded passwords are bad, and this is long text"', False), ('description: "password = 1"', False), ('api_key = "key"', False), ("token: abc", False), ("auth_token: abc", True), ("secret_key = token", False),
])
def test_secret_assignments(spark, line, found):
    got = secret_rules.secrets(lines(spark, "a.py", line)).filter("kind = 'pattern'").collect()
    assert (len(got) == 1) == found


def test_high_entropy_literals(spark):
    body = "AbCdEfGhIjKlMnOpQrStUvWxYz0123456789"
    text = "\n".join([f'a = "{body}"', f'b = "<div><span>{body}"', f'c = "{body} {{}}"', f"d = '{body[:8]}\\'{body[8:]}", f'e = "{body[:11]}"', f'f = "env::var {body}"', f'# "{body}"', 'h = "0123456789abcdef0123456789abcdef"'])
    got = secret_rules.secrets(lines(spark, "a.py", text)).orderBy("line").collect()
    assert [(r.line, r.severity, round(r.entropy, 4)) for r in got] == [(1, "medium", 5.1699), (4, "medium", 5.1699)]


def test_entropy_counts_bytes(spark):
    df = spark.createDataFrame([("éé",), ("aabb",), ("abcdefghijklmnopqrstuvwxyz",)], "t string")
    assert [round(r[0], 5) for r in df.select(metrics.entropy(F.col("t"))).collect()] == [1.0, 1.0, 4.70044]


def test_routes_and_middleware(spark):
    text = "app.get('/a', handler)\nrouter.get('/b', auth, handler)\napp.get('/health', h)\n@app.route('/c')\nr.GET('/d', f(1, 2), 3)\nrouter.get(f(a, b), \"x, y\")\n/*\napp.get('/e')\n*/\npassword = \"x\""
    df = lines(spark, "a.py", text)
    found = lambda d: [(r.line, r.rule_id) for r in scans.access_control(d, scans.app_wide_auth(d)).orderBy("line").collect()]
    assert found(df) == [(1, "ACL-AUTH-005"), (4, "ACL-AUTH-002"), (6, "ACL-AUTH-004"), (10, "ACL-CRED-001")]
    behind = lines(spark, "a.py", text + "\nrouter.Use(auth)")
    assert found(behind) == [(10, "ACL-CRED-001")]


def test_docstrings_and_order(spark):
    df = lines(spark, "a.py", '"""eval(a)\neval(b)\nos.system(c)')
    assert [r.line for r in scans.by_severity(scans.sast(df)).collect()] == [2, 3]
    severities = spark.createDataFrame([("b", 1, "low"), ("a", 9, "medium"), ("a", 2, "medium"), ("z", 1, "critical"), ("y", 1, "high")], "file string, line int, severity string")
    assert [r.severity for r in scans.by_severity(scans.at_least(severities, "medium")).collect()] == ["critical", "high", "medium", "medium"]
    assert scans.at_least(severities, "high").count() == 2 and scans.at_least(severities, "low").count() == 5


def test_halstead_comments(spark):
    got = halstead.halstead(corpus.lines(spark.createDataFrame([("a", "x = a + b"), ("b", "a # b // c"), ("c", "a # b"), ("d", "s = 'open")], "path string, content string")))
    by = {r.file: (r.n1, r.n2, r.total1, r.total2, r.volume) for r in got.collect()}
    assert by["a"] == (2, 3, 2, 3, 11.60964) and by["b"][3] == 2 and by["c"][3] == 1 and by["d"][1] == 2


def test_comment_ratio_by_extension(spark):
    df = files(spark, a_dot_rs="#[derive(A)]\n// c\n/// doc\nx", b_dot_py="# c\nx", c_dot_md="", d_dot_php="# c\n// d")
    by = {r.file: (r.code, r.comment, r.ratio) for r in metrics.comment_ratio(corpus.lines(df)).collect()}
    assert by == {"a.rs": (3, 1, 0.25), "b.py": (1, 1, 0.5), "d.php": (0, 2, 1.0)}


def test_typosquats(spark):
    popular = spark.createDataFrame([(0, "serde"), (1, "log"), (2, "tokio")], "ord int, popular string")
    names = spark.createDataFrame([("serdee",), ("serde",), ("lug",), ("Tokoi",), ("sedre",), ("tokyo",)], "name string")
    assert {tuple(r) for r in metrics.typosquats(names, popular).collect()} == {("serdee", "serde"), ("tokyo", "tokio")}


def test_dead_code(spark):
    df = files(spark, a_dot_py="import os\nfrom a import used, x\nused()\n", b_dot_js="import { q, r as s } from 'm'\nimport D from 'n'\nD()\nif (false) {", c_dot_rs="fn e()\n\n{}\nlet _ = f();\n#[allow(dead_code)]")
    assert sorted((r.file, r.line, r.kind) for r in flows.dead_code(df).collect()) == [
        ("a.py", 1, "unused_import"), ("b.js", 1, "unused_import"), ("b.js", 4, "unreachable_branch"), ("c.rs", 3, "empty_block"), ("c.rs", 4, "dead_assignment"), ("c.rs", 5, "allow_dead_code"),
    ]


def test_mutants(spark):
    df = lines(spark, "a.rs", "if a < b && true { x.checked_add(1) }\n// a < b\nlet s = c << 2; // true")
    got = {(r.line, r.category, r.original): r.mutated for r in flows.mutants(df).collect()}
    assert got[1, "boundary", " < "] == "if a <= b && true { x.checked_add(1) }" and got[1, "arithmetic", "checked_add"] == "if a < b && true { x.1) }"
    assert (3, "bitwise", " << ") in got and (3, "standard", "true") not in got and not any(k[0] == 2 for k in got)
    assert flows.limited(flows.mutants(df), 3).count() == 3


def test_types_documentation_and_properties(spark):
    python = lines(spark, "a.py", "def a(x: int):\n    pass\ndef b(self) -> None:\n    pass\ndef c() -> int:\n", "above")
    assert [r.typed for r in surface.typed_functions(python).orderBy("line").collect()] == [True, False, True]
    script = lines(spark, "a.js", "/** @param x */\n\nfunction f(x) {\n}\n\n\n\n\nfunction g(x) {", "above")
    assert [r.typed for r in surface.typed_functions(script).orderBy("line").collect()] == [True, False]
    empty = surface.coverage(surface.typed_functions(script).limit(0), [], "typed", 50.0)
    assert [(r.total, r.pct) for r in empty.collect()] == [(0, 100.0)]
    rust = lines(spark, "a.rs", "/// Doc.\n#[derive(A)]\npub struct S {\n}\npub fn f() {\n\n\n\n\npub(crate) async fn g() {", "above", "after")
    assert [(r.kind, r.documented) for r in surface.documented_items(rust).orderBy("line").collect()] == [("struct", True), ("fn", True), ("fn", False)]
    prop = files(spark, a_dot_rs="fn sum_all() {\n}\nproptest!(sum_all)\n#[test]\n", b_dot_py="@given(x)\ndef check(a):\n def test_a():\ndef test_b():")
    got = {r.name: (r.property_tested, r.unit_tested) for r in surface.property_coverage(corpus.lines(prop, "after")).collect()}
    assert got == {"sum_all": (True, True), "check": (True, False), "test_a": (False, True), "test_b": (False, True)}


def test_fuzz_surface(spark):
    df = files(spark, src__a_dot_rs="pub fn parse(data: &[u8], n: u32) {\nfn quiet(n: u32) {\nfn name(s: &str) {", fuzz__t_dot_rs="fuzz_target!(|d| { name(d) });", b_dot_java="public int size() {")
    known = corpus.lines(df)
    complexities = spark.createDataFrame([("src/a.rs", "parse", 1, 7)], "file string, name string, line int, complexity int")
    got = {r.name: (r.score, r.public, r.complexity, r.harnessed) for r in surface.fuzz_surface(known, surface.harness_names(known), complexities).collect()}
    assert got == {"parse": (44, True, 7, False), "name": (17, False, 10, True), "size": (10, True, 1, False)}


def test_imports(spark):
    df = files(spark, a_dot_rs="use crate::x;\nuse serde::Value;\nuse a::*;\nuse plain;", b_dot_py="import os, sys\nfrom a.b import c", c_dot_ts="import { x } from './m'\nconst y = require('z')", d_dot_go='import "fmt"\n\tlog "x/y"', e_dot_c='#include <stdio.h>\n#include "a.h"', f_dot_java="import static java.util.List.*;")
    got = imports.imports(corpus.lines(df))
    kept = got.filter(metrics.workspace_import(F.col("module"), F.col("file").endswith(".rs")))
    assert sorted((r.file, r.module) for r in kept.collect()) == [("a.rs", "crate::x"), ("a.rs", "plain"), ("b.py", "a.b"), ("b.py", "os"), ("c.ts", "./m"), ("c.ts", "z"), ("d.go", "fmt"), ("d.go", "x/y"), ("e.c", "a.h"), ("e.c", "stdio.h"), ("f.java", "java.util.List")]


def test_reading_a_tree(spark, tmp_path):
    root = tmp_path / ".cache" / "target" / "repo"
    for name in ("a.py", "b.txt", "sub/c.py", ".git/d.py", "sub/target/e.py", "vendor/f.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    got = corpus.read_files(spark, str(root), ("py",), ("vendor/",))
    assert sorted(r.path.split("repo/")[1] for r in got.collect()) == ["a.py", "sub/c.py"]
    assert corpus.workspace_root(spark, str(root)) == str(root) and corpus.lcov_file(spark, str(root)) is None
    (root / "Cargo.toml").write_text("[workspace]\n")
    (root / "crates").mkdir()
    (root / "lcov.info").write_text("FN:1,f\n")
    assert corpus.workspace_root(spark, str(root)).endswith("/crates") and corpus.lcov_file(spark, str(root)).endswith("lcov.info")


def test_mangled_names(spark):
    rec = spark.createDataFrame([("FN:3,_RNvCsXXX_4crate16my_function_name",), ("FNDA:5,_RNvCsXXX_4crate16my_function_name",), ("FNDA:1,_Rplain",)], "value string")
    assert {tuple(r) for r in corpus.lcov(rec).collect()} == {("my_function_name", 3, 5), ("_RNvCsXXX_4crate16my_function_name", 3, 5), ("_Rplain", None, 1)}


def test_reports_parse(spark):
    schema = "check string, ord long, file string, line long, column long, severity string, message string, rule_id string, fix_hint string"
    found = spark.createDataFrame([("sast", 1, "a", 3, None, "high", 'say "x" <y>', "R1", "h"), ("sast", 2, "", None, None, "low", "m", "R2", "h"), ("debt", 3, "b", 9, 2, "medium", "t", "R1", "h")], schema)
    state = spark.createDataFrame([("sast", False, "m", None, None, None, "."), ("debt", True, "m", None, None, None, ".")], "check string, passed boolean, message string, severity string, rule_id string, help string, path string")
    log = json.loads("\n".join(r.value for r in reports.sarif_log(found, state).orderBy("part", "ord").collect()))
    run = log["runs"][0]
    assert [(r["ruleId"], r["ruleIndex"], r["level"]) for r in run["results"]] == [("R1", 0, "error"), ("R2", 1, "note"), ("R1", 0, "warning")]
    assert run["invocations"][0]["exitCode"] == 1 and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R1", "R2"] and "region" not in json.dumps(run["results"][1])
    none = json.loads("\n".join(r.value for r in reports.sarif_log(found.limit(0), state.limit(0)).orderBy("part", "ord").collect()))
    assert none["runs"][0]["results"] == [] and none["runs"][0]["invocations"][0]["executionSuccessful"]
    suites = xml.dom.minidom.parseString("\n".join(r.value for r in reports.junit_suites(found, state).orderBy("part", "ord").collect())).getElementsByTagName("testsuite")
    assert [(s.getAttribute("name"), s.getAttribute("failures"), len(s.getElementsByTagName("testcase"))) for s in suites] == [("debt", "0", 1), ("sast", "2", 2)]
    known = spark.createDataFrame([("a&b", "1", "MIT", "pkg:x/a"), ("c", "2", None, "pkg:x/c")], "name string, version string, license string, purl string")
    xml.dom.minidom.parseString("\n".join(r.value for r in reports.cyclonedx(known, "app", "1", "T").orderBy("part", "ord").collect()))


def test_packages_of_bad_files(spark):
    df = spark.createDataFrame([("p/package-lock.json", "not json"), ("q/package.json", None), ("r/requirements.txt", ""), ("s/Cargo.lock", "[[package]]\nname = \"a\"\n")], "path string, content string")
    assert packages.inventory(df).count() == 0 and packages.findings_of(df, "R", "low").count() == 0 and packages.cargo_audit(df).count() == 0


def test_blame_and_hunks(spark):
    sha = "0123456789abcdef0123456789abcdef01234567"
    text = f"{sha} 5 7 2\nauthor Ann\nauthor-time {400 * 86400}\n\tcode\n{sha} 6 8\n\tmore"
    assert [tuple(r) for r in history.blame(one(spark, "f.rs", text)).orderBy("line").collect()] == [("f.rs", 5, "Ann", "1971-02-06"), ("f.rs", 6, "Ann", "1971-02-06")]
    diff = "diff --git a/x.rs b/src/x.rs\n@@ -1,2 +3,4 @@\n@@ -1 +9,0 @@\ndiff --git a/y.py b/y.py\n@@ -1 +1 @@"
    assert [tuple(r) for r in history.hunks(one(spark, "d", diff)).orderBy("start_line").collect()] == [("src/x.rs", 3, 6), ("src/x.rs", 9, 9)]


def test_truncation(spark):
    df = spark.createDataFrame([("abcdef",), ("日本語",), ("",)], "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select(T.truncate(t, 4), T.truncate_left(t, 4), T.truncate(t, 6), T.truncate(t, 0), T.width(t)).collect()]
    assert got == [("…def", "abc…", "abcdef", "", 6), ("…語", "日…", "日本語", "", 6), ("", "", "", "", 0)]


def test_parsed_shapes(spark):
    assert parse.python_shape("def f(x):\n    if x:\n        return g(x)\n    y = lambda: 1\n") == [("f", 1, ["IF", "RET", "CALL", "LET", "LAMBDA"])]
    assert grammar.shapes("fn f() { if a { return g(1); } else { let b = 2; } }", "rust") == [("f", 1, ["IF", "BLOCK", "RET", "CALL", "ELSE", "BLOCK", "LET"])]
    source = "pub struct S<T> {\n    pub a: u32,\n    b: T, // c: d\n}\nimpl<T> S<T> {\n    fn one(&self) { self.a }\n    pub fn two(&self) { self.b; self.a }\n    fn three() {}\n}\nstruct Alone { x: u8 }\n"
    assert parse.rust_structs(source) == [("S", "one", "a"), ("S", "two", "a"), ("S", "two", "b"), ("S", "three", None)]
    got = graphs.lcom4(parse.struct_methods(one(spark, "s.rs", source))).collect()
    assert [(r.type, r.methods, r.components) for r in got] == [("S", 3, 2)]


def test_registry_and_packs(spark):
    registry = checks.Registry()
    registry.check("ok")(lambda c: scans.crypto(c.table("lines")))
    registry.check("lost")(lambda c: c.table("nothing"))
    found, states = checks.run_checks(registry, checks.Context(spark, {"lines": lambda: lines(spark, "a.py", "hashlib.sha1(x)")}))
    assert [(r.check, r.rule_id) for r in found.collect()] == [("ok", "CRYPTO-HASH-004")]
    assert {r.check: r.available for r in states.collect()} == {"ok": True, "lost": False}
    empty = spark.createDataFrame([], "ord int, rule_id string, category string, severity string, pattern string, also string")
    assert checks.pack_findings(lines(spark, "a.py", "x"), empty).count() == 0


def test_cycles_are_dropped_within_the_wait(spark):
    now, seen = [0.0], []
    run = watch.debounced(lambda batch, cycle: seen.append(cycle), 2.0, lambda: now[0])
    for at, cycle in ((0.0, 1), (1.0, 2), (1.9, 3), (2.0, 4), (3.0, 5), (4.5, 6)):
        now[0] = at
        run(None, cycle)
    assert seen == [1, 4, 6]
    out = []
    full = watch.full_cycles(lambda s: one(s, "a", "x"), lambda f: f, lambda df, n: out.append((n, df.count())))
    full(one(spark, "b", "y"), 1)
    full(one(spark, "b", "y").limit(0), 2)
    assert out == [(1, 1)]


def test_event_streams(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    schema = "user_id long, ts timestamp, severity string, rule_id string"
    spark.sql("select 1L user_id, timestamp '2024-01-01 00:00:00' ts, 'high' severity, 'R' rule_id union all select 1L, timestamp '2024-01-01 00:05:00', 'low', 'R'").write.json(str(source))
    stream = spark.readStream.schema(schema).json(str(source))
    query = watch.write_events(watch.filtered(stream, ("high",)), str(sink), str(tmp_path / "c1"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.json(str(sink)).count() == 1
    joined = watch.followed(spark.readStream.schema(schema).json(str(source)), spark.readStream.schema(schema).json(str(source)))
    query = joined.writeStream.format("memory").queryName("followed_rows").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("followed_rows").count() == 1
