"""Call chains of any depth are followed to their end."""

from quillwork.operators import graphs


def test_transitive_callers_of_a_deep_chain(spark):
    calls = spark.createDataFrame([(f"f{i + 1}", f"f{i}") for i in range(56)] + [("f0", "f56")], "caller string, callee string")
    got = graphs.transitive_callers(calls, spark.createDataFrame([("f0",)], "name string"))
    assert {(r.name, r.depth) for r in got.collect()} == {(f"f{i}", i) for i in range(57)}
