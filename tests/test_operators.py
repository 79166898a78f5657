"""Operators on small hand-made corpora."""

from pyspark.sql import functions as F

from quillwork.operators import metrics, scans, scoring
from quillwork.sources import corpus


def lines(spark, content, path="a.rs"):
    return corpus.lines(spark.createDataFrame([(path, content)], "path string, content string"))


def test_line_split(spark):
    assert [r.text for r in lines(spark, "a\r\nb\n\nc\n").orderBy("line").collect()] == ["a", "b", "", "c"]
    assert lines(spark, "").count() == 0
    assert lines(spark, None).count() == 0


def test_first_rule_wins(spark):
    got = scans.crypto(lines(spark, "x = hashlib.md5(a)")).collect()
    assert [r.rule_id for r in got] == ["CRYPTO-HASH-002"]


def test_block_comment(spark):
    got = scans.sast(lines(spark, "/* open\neval(a)\n*/\neval(b)")).collect()
    assert [(r.line, r.rule_id) for r in got] == [(4, "SAST-EVAL-001")]


def test_crap(spark):
    f = spark.createDataFrame([("f", "a", 5), ("f", "b", 5), ("f", "c", 4)], "file string, name string, complexity int")
    c = spark.createDataFrame([("b", 3)], "function string, hits long")
    assert {r.name: r.crap for r in metrics.crap(f, c).collect()} == {"a": 30.0, "b": 5.0, "c": 20.0}


def test_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("abcdefgh",), ("",)], "t string")
    assert [round(r[0], 6) for r in df.select(metrics.entropy(F.col("t"))).collect()] == [1.0, 3.0, 0.0]


def test_risk(spark):
    churn = spark.createDataFrame([("a", 9), ("b", 16), ("c", 25), ("d", 400)], "file string, commits int")
    fns = spark.createDataFrame([("a", 30), ("b", 100), ("c", 200), ("d", 200)], "file string, complexity int")
    assert {r.file: (r.risk, r.level) for r in metrics.risk(churn, fns).collect()} == {"a": (4, "LOW"), "b": (20, "MEDIUM"), "c": (50, "HIGH"), "d": (100, "DANGER")}


def test_license_classes(spark):
    names = ["MIT", "LGPL-3.0", "GPL-3.0-only", "MPL-2.0", "", "Foo"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(metrics.license_class(F.col("n"))).collect()] == ["permissive", "copyleft-weak", "copyleft-strong", "copyleft-weak", "unknown", "other"]


def test_health(spark):
    checks = spark.createDataFrame([("secrets", False), ("debt", True)], "name string, passed boolean")
    assert [tuple(r) for r in scoring.health(checks).collect()] == [(25, "F")]
    assert [tuple(r) for r in scoring.health(checks.limit(0)).collect()] == [(100, "A")]


def test_locked_packages(spark):
    lock = '[[package]]\nname = "a"\nversion = "1.0"\nchecksum = "ff"\n\n[[package]]\nname = "b"\nversion = "2.0"\n'
    got = {r.name: (r.version, r.checksum) for r in corpus.locked_packages(lines(spark, lock, "Cargo.lock")).collect()}
    assert got == {"a": ("1.0", "ff"), "b": ("2.0", None)}


def test_lcov(spark):
    rec = spark.createDataFrame([("FN:3,f",), ("FNDA:2,f",), ("FNDA:5,f",), ("FNDA:0,g",)], "value string")
    assert {tuple(r) for r in corpus.lcov(rec).collect()} == {("f", 3, 7), ("g", None, 0)}
