"""What a join or a task holds doesn't grow beyond its share: exploded rows are many times what Spark estimates."""

from quillwork.operators import fixes, graphs, metrics
from quillwork.sources import corpus


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def keys(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/keys")
    return spark.read.parquet(f"{tmp_path}/keys")  # a few bytes of a column, by which sizes are estimated


def functions_of(k):
    return k.selectExpr("concat('src/s', id, '.rs') as file", "explode(sequence(0, 9)) as n").selectExpr("file", "concat('fn', n) as name", "n * 25 as line", "n * 25 + 20 as end_line")


def test_changed_functions_are_not_broadcast(spark, tmp_path):
    k = keys(spark, tmp_path)
    functions = functions_of(k)
    hunks = k.selectExpr("concat('s', id, '.rs') as file", "id % 250 as start_line", "id % 250 + 10 as end_line")
    touched = metrics.overlapping(hunks, functions)
    within = metrics.lines_within(k.selectExpr("concat('src/s', id, '.rs') as file", "id as line"), functions, touched)
    assert "BroadcastHashJoin" not in plan_of(touched) and "BroadcastHashJoin" not in plan_of(within)
    assert touched.count() == sum(a <= n * 25 + 20 and a + 10 >= n * 25 for a in range(100) for n in range(10))


def test_call_edges_are_not_broadcast(spark, tmp_path):
    k = keys(spark, tmp_path)
    functions = k.selectExpr("concat('k', id, '.rs') as file", "explode(array(struct('aa' as name, 1 as line, 2 as end_line), struct('b' as name, 3 as line, 4 as end_line))) as f").select("file", "f.*")
    lines = k.selectExpr("concat('k', id, '.rs') as path", "explode(array(struct(2 as line, 'b(1)' as text), struct(4 as line, 'x' as text))) as l").selectExpr("path", "l.line", "l.text", "l.text as trimmed")
    found = graphs.call_edges(lines, functions)
    assert "BroadcastHashJoin" not in plan_of(found)
    assert {(r.caller, r.callee) for r in found.collect()} == {("aa", "b")} and found.count() == 100


def test_cohesion_runs_no_python_per_type(spark):
    rows = [("p", "T", "a", "x"), ("p", "T", "b", "x"), ("p", "T", "c", "y"), ("p", "T", "b", "y"), ("p", "T", "d", None), ("p", "T", "d", None), ("p", "T", None, "z"), ("p", "One", "a", "x"), (None, "T", "a", None), (None, "T", "b", None)]
    found = graphs.lcom4(spark.createDataFrame(rows, "path string, type string, method string, field string"))
    assert "Pandas" not in plan_of(found)
    assert {tuple(r) for r in found.collect()} == {("p", "T", 5, 3), (None, "T", 2, 2)}


def test_tokens_are_made_once_for_duplicates(spark):
    prints = spark.createDataFrame([(1, ["IF"] * 5), (2, ["IF", "CALL", "IF", "IF", "IF"]), (3, ["FOR"] * 5), (4, ["IF"] * 4)], "ord long, tokens array<string>")
    found = graphs.duplicate_groups(prints)
    assert "ExistingRDD" not in plan_of(found) and "LocalTableScan" not in plan_of(found)
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_patches_are_not_broadcast(spark, tmp_path):
    k = keys(spark, tmp_path)
    files = k.selectExpr("concat('f', id, '.rs') as path", "'a\nb' as content")
    patches = k.selectExpr("concat('f', id, '.rs') as file", "2 as line", "0 as ord", "'b' as old_text", "'c' as new_text")
    done = fixes.applied(files, patches)
    assert "BroadcastHashJoin" not in plan_of(done)
    assert {(r.content, r.n_applied) for r in done.collect()} == {("a\nc", 1)} and done.count() == 100


def test_keys_of_files_are_spread(spark):
    dealt = corpus.spread(spark.range(0, 25_000, 1, 1)).rdd.glom().map(len).collect()
    assert len(dealt) >= 3 and max(dealt) <= corpus.FILES and sum(dealt) == 25_000
    assert corpus.spread(spark.range(0)).count() == 0


def test_inline_auth_asks_for_the_method_first(spark):
    from pyspark.sql import functions as F

    from quillwork.operators import scans

    rows = [("router.get('/b', auth, handler)", True), ("app.get('/a', handler)", False), ("f(a, b, c)", False), ("router.get(f(a, b), g('x, y', 2), h)", True), ("r.GET('/d', f(1, 2, 3))", False), ("@UseGuards(x)", True)]
    found = spark.createDataFrame(rows, "text string, want boolean").select("want", scans.has_inline_auth(F.col("text")).alias("got"))
    assert plan_of(found).lower().count("contains(lower(text") >= len(scans.tables.ROUTE_METHODS)
    assert [r.got for r in found.collect()] == [r.want for r in found.collect()]
