"""Parsing, graphs, life cycle, sinks and streams on small inputs."""

from pyspark.sql import functions as F

from quillwork.operators import grammar, graphs, lifecycle, parse, scoring
from quillwork.sources import corpus, sinks
from quillwork.streaming import watch


def test_python_functions():
    source = "def a(x):\n    if x:\n        for y in x:\n            pass\n    return 1\n\n@d\ndef b():\n    return 2\n"
    assert parse.python_functions(source) == [("a", 1, 5, 3), ("<anonymous>", 7, 9, 1), ("b", 8, 9, 1)]


def test_brace_functions():
    source = 'pub fn helper() -> u32 {\n    1 // if\n}\n\npub fn process(x: u32) {\n    if x > 1 { }\n    for i in 0..x { let s = "if {"; }\n}\n'
    assert [(n, a, c) for n, a, _, c in grammar.functions(source, "rust")] == [("helper", 1, 1), ("process", 5, 3)]


def test_functions_table(spark):
    files = corpus.with_language(spark.createDataFrame([("a.py", "def f(:\n"), ("b.py", "def g():\n  pass\n"), ("c.md", "x"), ("d.py", None)], "path string, content string"))
    assert {(r.path, r.name, r.parse_error) for r in parse.functions(files).collect()} == {("a.py", None, True), ("b.py", "g", False)}


def test_callers_of_a_cycle(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "caller string, callee string")
    got = graphs.transitive_callers(calls, spark.createDataFrame([("c",)], "name string"))
    assert {(r.name, r.depth) for r in got.collect()} == {("c", 0), ("b", 1), ("a", 2)}


def test_lcom4(spark):
    rows = [("p", "T", "m1", "x"), ("p", "T", "m2", "x"), ("p", "T", "m3", None), ("p", "U", "m1", "x")]
    got = graphs.lcom4(spark.createDataFrame(rows, "path string, type string, method string, field string")).collect()
    assert [(r.type, r.methods, r.components) for r in got] == [("T", 3, 2)]


def test_duplicate_groups_are_greedy(spark):
    rows = [(1, list("abcde")), (2, list("abcdf")), (3, list("abcde")), (4, list("abcdef")), (5, list("ab"))]
    got = {r.ord: r.group for r in graphs.duplicate_groups(spark.createDataFrame(rows, "ord long, tokens array<string>"), names=tuple("abcdef")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1}


def test_exceptions_and_remediation(spark):
    log = spark.createDataFrame([("a", "open"), ("b", "open"), ("c", "closed")], "finding_id string, status string")
    now = spark.createDataFrame([("b",), ("d",)], "finding_id string")
    assert {tuple(r) for r in lifecycle.remediate(log, now).collect()} == {("a", "closed"), ("b", "open"), ("c", "closed"), ("d", "open")}


def test_sinks(spark):
    found = spark.createDataFrame([("a<b", 3, "R", "critical")], "file string, line int, rule_id string, severity string")
    assert '"level":"error"' in sinks.sarif_results(found).first().value
    assert "a&lt;b" in sinks.junit_cases(found).first().value
    assert len(sinks.signed(found.select("file", "rule_id"), b"key").first().signature) == 64


def test_watch_and_cycles(spark, tmp_path):
    folder, state, seen = tmp_path / "in", str(tmp_path / "state"), []
    folder.mkdir()
    (folder / "a.txt").write_text("x = eval(y)\n")
    query = watch.watch_files(spark, str(folder), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "check"), "0 seconds")
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 1 and seen[0].endswith("a.txt")
    changes = []
    run = watch.cycle_difference(state, ["name"], lambda df, n: changes.extend((n, r.name, r.status) for r in df.collect()))
    table = lambda ok: spark.createDataFrame([("sast", ok), ("debt", True)], "name string, passed boolean")
    for n, ok in enumerate([True, False, True]):
        run(table(ok), n)
    assert changes == [(1, "sast", "regressed"), (2, "sast", "improved")]


def test_windows(spark):
    e = spark.sql("select timestamp '2024-01-01 00:10:00' ts, 'a' event_type, 2.0D value, 1 user_id union all select timestamp '2024-01-01 00:50:00', 'a', 3.0D, 1")
    assert [(r.n, r.total) for r in watch.windowed_counts(e).collect()] == [(2, 5.0)]
    assert watch.sessions(e).count() == 2


def test_opinions(spark):
    checks = spark.createDataFrame([("r", "debt", True, False)], "run string, name string, passed boolean, skipped boolean")
    assert [tuple(r) for r in scoring.audit(checks, ["run"]).collect()] == [("r", 100, "A", "ADVERSE")]
    assert spark.range(1).select(scoring.sarif_level(F.lit("info"))).first()[0] == "warning"
