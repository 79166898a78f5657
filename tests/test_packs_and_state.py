"""Rule packs of any length, and the state of cycles between triggers and over a restart."""

import random

from pyspark.sql import functions as F

from quillwork.operators import checks
from quillwork.operators.scans import first_match
from quillwork.streaming import watch

PACK = "ord int, rule_id string, category string, severity string, pattern string, also string"


def test_first_rule_wins_as_in_a_chain(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abc ") for _ in range(r.randrange(1, 4)))
    rules = [(n, f"R{n}", "c", "low", word(), word() if n % 3 == 0 else ["", None][n % 2]) for n in range(300)]
    r.shuffle(rules)
    lines = spark.createDataFrame([("f", n, "".join(r.choice("abc d") for _ in range(r.randrange(8)))) for n in range(400)] + [("f", 999, None)], "path string, line int, text string")
    pack = spark.createDataFrame(rules, PACK)
    ordered = pack.fillna({"also": ""}).orderBy("ord").collect()
    names = F.array(*[F.lit(x["rule_id"]) for x in ordered])
    want = {(x.line, x.rule) for x in lines.withColumn("n", first_match(F.col("text"), ordered)).filter("n is not null").select("line", F.element_at(names, F.col("n") + 1).alias("rule")).collect()}
    got = checks.pack_findings(lines, pack)
    assert got.columns == ["file", "line", "rule_id", "category", "severity"]
    assert {(x.line, x.rule_id) for x in got.collect()} == want and len(want) > 100


def test_many_rules(spark):
    rules = [(n, f"R{n}", "c", "high", f"key{n}=", "") for n in range(50_000)] + [(50_000, "LAST", "c", "low", "", "needle")]
    lines = spark.createDataFrame([("f", 1, "x key49999= key17= y"), ("f", 2, "a needle"), ("f", 3, "key17 =")], "path string, line int, text string")
    got = checks.pack_findings(lines, spark.createDataFrame(rules, PACK))
    assert sorted((x.line, x.rule_id) for x in got.collect()) == [(1, "R17"), (2, "LAST")]
    assert checks.pack_findings(lines, spark.createDataFrame([], PACK)).count() == 0


def test_state_over_triggers_and_a_restart(spark, tmp_path):
    r = random.Random(9)
    rows = [(f"c{k}", cycle, r.random() < 0.5) for cycle in range(6) for k in range(5) for _ in range(2)]
    schema = "name string, cycle long, passed boolean"
    found = []

    def run(cycles):
        spark.createDataFrame([x for x in rows if x[1] in cycles], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = watch.stateful_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["name"], ["cycle"])
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, _: found.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
        query.awaitTermination()

    run({0, 1})
    run({2})
    run({3, 4, 5})
    merged = spark.createDataFrame(rows, schema).groupBy("name", "cycle").agg(F.bool_and("passed").alias("passed"))
    want = sorted(map(tuple, watch.changes(merged, ["name"], ["cycle"]).collect()))
    assert sorted(found) == want and want
    assert sorted(map(tuple, watch.stateful_changes(merged, ["name"], ["cycle"]).collect())) == want


def test_events_are_delivered_in_order_and_bounded(spark):
    findings = spark.createDataFrame([(f"c{n % 2}", f"f{n:03d}", n, "R", "low") for n in range(250)], "check string, file string, line int, rule_id string, severity string").repartition(5)
    results = spark.createDataFrame([("c1", True), ("c0", True), ("c2", False)], "check string, available boolean")
    sizes, got = [], []
    counts = watch.deliver(watch.ordered_events(findings, results), lambda part: (sizes.append(len(part)), got.extend((r.check, r.kind, r.file) for r in part)))
    assert max(sizes) == watch.CAPACITY and sizes[:-1] == [watch.CAPACITY] * (len(sizes) - 1)
    want = []
    for check in ("c0", "c1", "c2"):
        want += [(check, "finding", f"f{n:03d}") for n in range(250) if f"c{n % 2}" == check] + [(check, "rule_complete", None), (check, "progress", None)]
    assert got == [*want, (None, "end", None)]
    assert counts == {"finding": 250, "rule_complete": 3, "progress": 3, "end": 1}
