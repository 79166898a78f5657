"""Code metrics, dependency and graph measures."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import extension
from . import ranges


# Extensions by how their comments begin, and documentation comments by extension.
C_LIKE = ("rs", "c", "cpp", "cc", "cxx", "h", "hpp", "cs", "java", "js", "ts", "tsx", "mjs", "go", "swift")
HASH_ONLY = ("py", "pyi", "rb")
DOC_COMMENTS = {("rs",): r"^(///|//!|/\*\*)", ("js", "ts", "tsx", "java", "cs"): r"^(/\*\*|\* |\*/)", ("py", "pyi"): "^(\"\"\"|''')"}


def comment_ratio(lines: DataFrame, least: float | None = None) -> DataFrame:
    """(file, code, comment, blank, ratio[, below]): what begins a comment depends on the extension; documentation
    comments count as code. A file without code or comment has the ratio 1. below: a ratio under least in a file
    of more than ten lines that aren't blank."""
    t, ext = F.col("trimmed"), extension(F.col("path"))
    plain = F.when(ext.isin(*C_LIKE), t.rlike(r"^(//|/\*|\*)")).when(ext.isin(*HASH_ONLY), t.startswith("#")).when(ext == "php", t.rlike(r"^(//|#|/\*|\*)")).otherwise(t.rlike("^(//|#)"))
    doc = F
    for extensions, pattern in DOC_COMMENTS.items():
        doc = doc.when(ext.isin(*extensions), t.rlike(pattern))
    kind = F.when(t == "", "blank").when(plain & ~doc.otherwise(False), "comment").otherwise("code")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    counts = lines.select(F.col("path").alias("file"), kind.alias("kind")).groupBy("file").agg(n("code"), n("comment"), n("blank"))
    total = F.col("code") + F.col("comment")
    full = counts.withColumn("ratio", F.round(F.when(total > 0, F.col("comment") / total).otherwise(1.0), 6))
    return full if least is None else full.withColumn("below", (F.col("ratio") < least) & (total > 10))


def long_functions(functions: DataFrame, most: int = 40) -> DataFrame:
    """Functions (file, name, line, end_line) of more lines than that, with n_lines."""
    return functions.withColumn("n_lines", F.col("end_line") - F.col("line") + 1).filter(F.col("n_lines") > most)


def long_files(lines: DataFrame, most: int = 500) -> DataFrame:
    return lines.groupBy(F.col("path").alias("file")).agg(F.count(F.lit(1)).alias("n_lines")).filter(F.col("n_lines") > most)


# Functions that aren't unit-testable, left out by the tool.
ENTRY_POINTS = ("main", "output_table", "output_json", "output_ndjson", "run_self_test")


def crap_gate(scores: DataFrame, most: float = 30.0) -> DataFrame:
    """One row (average, passed): the mean score decides, 0 without functions."""
    return average(scores, "crap", 0.0).withColumn("passed", F.col("average") <= most)


def complexity_gate(functions: DataFrame, limit: int = 10, most: int = 0) -> DataFrame:
    """One row (violations, passed): functions of that complexity or more."""
    return functions.agg(F.count(F.when(F.col("complexity") >= limit, 1)).alias("violations")).withColumn("passed", F.col("violations") <= most)


def unsafe_blocks(lines: DataFrame) -> DataFrame:
    """(file, unsafe) of Rust files (lines: path, text) that hold unsafe blocks."""
    n = F.regexp_count("text", F.lit(r"\bunsafe\s*\{"))
    return lines.filter(F.col("path").endswith(".rs")).groupBy(F.col("path").alias("file")).agg(F.sum(n).cast("long").alias("unsafe")).filter("unsafe > 0")


def danger_zone(risks: DataFrame) -> DataFrame:
    """(file): complex files that change often."""
    return risks.filter((F.col("commits") > 5) & (F.col("complexity") > 20)).select("file")


def crap(functions: DataFrame, coverage: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """(file, name, complexity, crap, band) of functions left-joined with hits by name; skipped names are left out."""
    functions = functions.filter(~F.col("name").isin(*skipped)) if skipped else functions
    hits = coverage.groupBy(F.col("function").alias("name")).agg(F.max("hits").alias("hits"))
    c = F.col("complexity").cast("double")
    covered = F.when(F.coalesce("hits", F.lit(0)) > 0, 1.0).otherwise(0.0)
    score = c * c * F.pow(1 - covered, F.lit(3.0)) + c
    band = F.when(F.col("crap") > 30, "crappy").when(F.col("crap") > 20, "acceptable").when(F.col("crap") > 10, "good").otherwise("excellent")
    return functions.join(hits, "name", "left").select("file", "name", "complexity", score.alias("crap")).withColumn("band", band)


def risk(churn: DataFrame, functions: DataFrame, unsafe: DataFrame | None = None) -> DataFrame:
    """(file, commits, complexity, risk, level): the square root of churn times complexity, over 20, to 100. An
    unsafe block (unsafe: file, unsafe) counts as two more of complexity for the score."""
    cx = functions.groupBy("file").agg(F.sum("complexity").alias("complexity"))
    more = F.lit(0)
    if unsafe is not None:
        cx, more = cx.join(unsafe, "file", "left"), 2 * F.coalesce("unsafe", F.lit(0))
    score = F.least(F.lit(100), F.floor(F.sqrt(F.col("commits").cast("double")) * (F.col("complexity") + more) / 20)).cast("int")
    level = F.when(F.col("risk") >= 70, "DANGER").when(F.col("risk") >= 40, "HIGH").when(F.col("risk") >= 20, "MEDIUM").otherwise("LOW")
    return churn.join(cx, "file").select("file", "commits", "complexity", score.alias("risk")).withColumn("level", level)


def hottest(functions: DataFrame, per_file: int = 3, above: int = 3) -> DataFrame:
    w = Window.partitionBy("file").orderBy(F.desc("complexity"), "name")
    return functions.filter(F.col("complexity") > above).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_file)


def coupling(edges: DataFrame) -> DataFrame:
    """(module, fan_out, fan_in, instability) of distinct import edges (src, dst)."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("module")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("module")).agg(F.count(F.lit(1)).alias("fan_in"))
    both = out.join(into, "module", "full").na.fill(0, ["fan_out", "fan_in"])
    return both.withColumn("instability", F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 6))


def workspace_import(module: Column, rust: Column) -> Column:
    """Imports that likely name a module of the same workspace: no wildcards, and in Rust no foreign paths."""
    own = module.startswith("crate::") | module.startswith("self::") | module.startswith("super::") | ~module.contains("::")
    return ~module.endswith("::*") & (~rust | own)


def average_fan_out(modules: DataFrame) -> DataFrame:
    return average(modules, "fan_out", 0.0)


# Licenses that a project denies unless it says otherwise.
DENIED = ("AGPL-3.0", "AGPL-1.0", "GPL-3.0", "GPL-2.0", "GPL-1.0")


def license_findings(packages: DataFrame, denied: tuple[str, ...] = DENIED, deny_unknown: bool = False) -> DataFrame:
    """(package, version, license, category, violation) of packages (name, version, license): copyleft ones, and
    those whose license holds a denied one, or is unknown where that is denied too."""
    category = license_class(F.col("license"))
    upper = F.upper(F.trim(F.coalesce("license", F.lit(""))))
    violation = reduce(or_, [upper.contains(d.upper()) for d in denied], F.lit(False)) | (F.lit(deny_unknown) & (category == "unknown"))
    each = packages.select(F.col("name").alias("package"), "version", "license", category.alias("category"), violation.alias("violation"))
    return each.filter(F.col("violation") | F.col("category").startswith("copyleft"))


def license_class(name: Column) -> Column:
    """Category of a license name: the first that applies, strongest first."""
    u = F.upper(F.trim(name))
    any_of = lambda *words: reduce(or_, [u.contains(w) for w in words])
    return (
        F.when(any_of("AGPL"), "copyleft-strong").when(any_of("LGPL"), "copyleft-weak")
        .when(any_of("GPL-3", "GPL-2", "GPL-1") | (u == "GPL"), "copyleft-strong")
        .when(any_of("MPL", "EUPL", "CDDL", "EPL"), "copyleft-weak")
        .when(any_of("MIT", "BSD", "APACHE", "ISC", "ZLIB", "WTFPL", "PSF", "CC0", "UNLICENSE", "BOOST"), "permissive")
        .when(u.isNull() | u.isin("", "UNKNOWN", "NONE"), "unknown").otherwise("other")
    )


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's UTF-8 bytes, in bits: sorted, equal bytes are runs, which one pass counts."""
    octets = F.array_sort(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), 0))
    n = F.octet_length(text).cast("double")
    weight = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("done"))

    def step(at: Column, x: Column) -> Column:
        same = at["last"] == x
        return F.struct(x.alias("last"), F.when(same, at["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, at["done"]).otherwise(at["done"] + weight(at["run"])).alias("done"))

    total = F.aggregate(octets, zero, step, lambda at: at["done"] + weight(at["run"]))
    return F.when(n == 0, 0.0).otherwise(F.log2(n) - total / n)


def one_off(name: Column) -> Column:
    """The name and what is left of it without one of its characters: names an edit apart share one of these."""
    each = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.left(name, i - 1), F.substr(name, i + 1)))
    return F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 0, each).otherwise(F.array().cast("array<string>"))))


def typosquats(packages: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, like): names one edit away from a popular one (ord, popular) of over three characters; the first in
    order. Candidates meet by an equi-join on names less one character, whatever the size of either table."""
    known = popular.filter(F.length("popular") > 3).select("ord", "popular", F.explode(one_off(F.col("popular"))).alias("part"))
    asked = packages.select("name").distinct().select("name", F.explode(one_off(F.lower("name"))).alias("part"))
    near = asked.join(known, "part").filter(F.levenshtein(F.lower("name"), "popular") == 1)
    return near.groupBy("name").agg(F.min_by("popular", "ord").alias("like"))


def bill_of_materials(packages: DataFrame) -> DataFrame:
    """Packages with a purl, the first of each purl kept."""
    purl = F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "name", F.lit("@"), "version")
    w = Window.partitionBy("purl").orderBy("ord")
    return packages.withColumn("purl", purl).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "ord")


def overlapping(hunks: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions (file, name, line, end_line) that a changed range (file, start_line, end_line) touches; a function's
    path ends in a range's, and may have more in front of it."""
    pairs = ranges.ending(functions, hunks.select(F.col("file").alias("end")))
    changed = ranges.dealt(hunks.withColumnRenamed("file", "end")).join(pairs, "end").select("file", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    named = ranges.dealt(functions).join(pairs.select("file").distinct(), "file", "left_semi").select("file", "name", F.col("line").alias("first"), F.col("end_line").alias("last"))
    return ranges.overlapping(named, changed.distinct()).select("file", "name").distinct()


def lines_within(rows: DataFrame, functions: DataFrame, affected: DataFrame) -> DataFrame:
    """The rows (file, line, ...) that lie in a function (file, name, line, end_line) that is affected (file, name)."""
    spans = ranges.dealt(functions).join(affected.select("file", "name").distinct(), ["file", "name"], "left_semi").select("file", F.col("line").alias("first"), F.col("end_line").alias("last"))
    near = spans.distinct().withColumn("bucket", ranges.buckets(F.col("first"), F.col("last")))
    within = (F.col("r.file") == F.col("n.file")) & (F.floor(F.col("r.line") / ranges.LINES) == F.col("bucket")) & F.col("r.line").between(F.col("first"), F.col("last"))
    return ranges.dealt(rows.alias("r")).join(near.alias("n"), within, "left_semi")


def reduction(functions: DataFrame, affected: DataFrame) -> DataFrame:
    """One row (total, affected, pct): the share of functions that a delta run leaves out."""
    total, hit = functions.agg(F.count(F.lit(1)).alias("total")), affected.agg(F.count(F.lit(1)).alias("affected"))
    pct = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.round((F.col("total") - F.col("affected")) * 100.0 / F.col("total"), 6))).otherwise(0.0)
    return total.crossJoin(hit).withColumn("pct", pct)  # one row each


def average(rows: DataFrame, value: str, empty: float) -> DataFrame:
    """One row (average): empty for a table without rows."""
    return rows.agg(F.round(F.coalesce(F.avg(value), F.lit(empty)), 6).alias("average"))


def islands(lines: DataFrame) -> DataFrame:
    """(file, first, last) of contiguous line runs."""
    w = Window.partitionBy("file").orderBy("line")
    return lines.distinct().withColumn("g", F.col("line") - F.row_number().over(w)).groupBy("file", "g").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("g")
