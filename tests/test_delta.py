"""Changed ranges, call edges and closures of a change."""

from quillwork.operators import graphs, metrics, parse, ranges
from quillwork.sources import corpus

ADD = "\nfn add(a: i32, b: i32) -> i32 {\n    a + b\n}\n\nfn double(x: i32) -> i32 {\n    add(x, x)\n}\nfn quadruple(x: i32) -> i32 { double(double(x)) }\n"


def functions(spark, files):
    df = corpus.with_language(spark.createDataFrame(files, "path string, content string"))
    return df, parse.functions(df).select(parse.F.col("path").alias("file"), "name", "line", "end_line")


def test_changed_functions_and_their_callers(spark):
    files, found = functions(spark, [("r/test.rs", ADD), ("r/other.rs", ADD)])
    hunks = spark.createDataFrame([("test.rs", 2, 4)], "file string, start_line int, end_line int")
    changed = metrics.overlapping(hunks, found)
    assert [tuple(r) for r in changed.collect()] == [("r/test.rs", "add")]
    edges = graphs.call_edges(corpus.lines(files), found)
    assert {tuple(r) for r in edges.collect()} == {(f, a, b) for f in ("r/test.rs", "r/other.rs") for a, b in (("double", "add"), ("quadruple", "double"))}
    got = graphs.transitive_callers(edges, changed)
    assert {(r.name, r.depth) for r in got.collect()} == {("add", 0), ("double", 1), ("quadruple", 2)}


def test_calls_count_wherever_the_name_is_found(spark):
    body = ["self.foo()", "x.foo(y)", "prefoo(1)", "Foo::bar()", "bar::baz", "take(&mut barrel)", "// foo()", "let a = foo();", "foo", "main(1)", "foo (1)"]
    files = spark.createDataFrame([("m.rs", "\n".join(body))], "path string, content string")
    starts = [("foo", 20, 21), ("bar", 22, 23), ("baz", 24, 25), ("Foo", 26, 27), ("main", 1, 11), ("inner", 3, 4)]
    found = spark.createDataFrame([("m.rs", *s) for s in starts], "file string, name string, line int, end_line int")
    got = {(r.caller, r.callee) for r in graphs.call_edges(corpus.lines(files), found).collect()}
    want = set()
    for name, first, last in starts:
        for line in body[first - 1 : last]:
            if not line.startswith(("//", "let ")):
                want |= {(name, other) for other, *_ in starts if other != name and (f"{other}(" in line or f"{other}::" in line or f"&mut {other}" in line)}
    assert got == want and ("main", "bar") in got and ("inner", "foo") in got


def test_paths_that_end_in_another(spark):
    paths = ["a/src/mod.rs", "b/mysrc/mod.rs", "src/mod.rs", "mod.rs", "c/lib.rs", "é/ß.rs"]
    ends = ["src/mod.rs", "mod.rs", "ß.rs", "none.rs", "a/b/src/mod.rs"]
    got = ranges.ending(spark.createDataFrame([(p,) for p in paths], "file string"), spark.createDataFrame([(e,) for e in ends], "end string"))
    assert {tuple(r) for r in got.collect()} == {(p, e) for p in paths for e in ends if p.endswith(e)}


def test_ranges_meet_once(spark):
    left = [("a", 1, 1000), ("a", 64, 64), ("a", 5, 4), ("b", 128, 191)]
    right = [("a", 63, 65, "x"), ("a", 1000, 2000, "y"), ("b", 1, 127, "z"), ("b", 191, 192, "w")]
    got = ranges.overlapping(spark.createDataFrame(left, "file string, first int, last int"), spark.createDataFrame(right, "file string, first int, last int, n string"))
    want = sorted((f, a, b, n) for f, a, b in left for g, c, d, n in right if f == g and a <= d and b >= c and a <= b)
    assert sorted((r.file, r.first, r.last, r.n) for r in got.collect()) == want


def test_lines_of_affected_functions(spark):
    rows = spark.createDataFrame([("t.rs", n) for n in (1, 2, 3, 4, 63, 64, 200)] + [("u.rs", 2)], "file string, line int")
    found = spark.createDataFrame([("t.rs", "foo", 1, 3), ("t.rs", "bar", 60, 130), ("t.rs", "bar", 2, 4), ("u.rs", "foo", 1, 3)], "file string, name string, line int, end_line int")
    affected = spark.createDataFrame([("t.rs", "foo"), ("t.rs", "bar")], "file string, name string")
    assert sorted(r.line for r in metrics.lines_within(rows, found, affected).collect()) == [1, 2, 3, 4, 63, 64]


def test_greedy_groups_of_shapes(spark):
    import random

    r, rows = random.Random(2), []
    for n in range(400):
        rows.append((n * 7 % 401, r.sample(graphs.TOKENS, r.randrange(1, 9)) * r.randrange(1, 3)))
    got = {x.ord: x.group for x in graphs.duplicate_groups(spark.createDataFrame(rows, "ord long, tokens array<string>"), min_tokens=3).collect()}
    seeds, want = [], {}
    for n, tokens in sorted(rows):
        if len(tokens) >= 3:
            mine = set(tokens)
            want[n] = next((s for s, t in seeds if len(mine & t) / len(mine | t) >= 0.7), n)
            if want[n] == n:
                seeds.append((n, mine))
    assert got == want and len(set(want.values())) > 20
