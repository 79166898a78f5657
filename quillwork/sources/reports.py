"""Whole reports as rows (part, ord, value): the lines of a document in the order of part and ord.

Heads, tails and tables of rules are few rows; findings stay distributed, and ``write_document`` sorts them
by range, so that no task holds a report. Findings are (check, ord, file, line, column, severity, message,
rule_id, fix_hint), checks (check, passed, message, severity, rule_id, help), ord a finding's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scoring import sarif_level
from .sinks import xml_escaped

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
TOOL, VERSION = "quillwork", "1.0.0"


def _line(part: int, ord_: Column, value: Column) -> list[Column]:
    return [F.lit(part).alias("part"), ord_.cast("long").alias("ord"), value.alias("value")]


def _fixed(df: DataFrame, part: int, value: Column) -> DataFrame:
    """One row, whatever df holds."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(*_line(part, F.lit(0), value))


def _listed(rows: DataFrame, part: int, ord_: Column, value: Column, comma: str = ",") -> DataFrame:
    """Rows with a comma before all but the first: the least ord is one row."""
    least = rows.agg(F.min(ord_).alias("__first"))
    each = rows.crossJoin(F.broadcast(least))
    return each.select(*_line(part, ord_, F.concat(F.when(ord_ == F.col("__first"), "").otherwise(comma), value)))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, index, level, message, fix_hint): rules in the order in which findings first show them."""
    first = F.min_by(F.struct("severity", "message", "fix_hint"), "ord").alias("f")
    rules = findings.groupBy("rule_id").agg(F.min("ord").alias("first"), first)
    index = F.row_number().over(Window.orderBy("first")) - 1  # as many rows as there are rules
    return rules.select("rule_id", index.alias("index"), sarif_level(F.col("f.severity")).alias("level"), F.col("f.message").alias("message"), F.col("f.fix_hint").alias("fix_hint"))


def sarif_log(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """A SARIF 2.1.0 log of one run."""
    rules = sarif_rules(findings)
    text = lambda c: F.struct(F.col(c).alias("text"))
    rule = F.to_json(F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), text("message").alias("shortDescription"), text("fix_hint").alias("fullDescription"), text("fix_hint").alias("help"),
        F.struct("level").alias("defaultConfiguration"),
    ))
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")))
    place = F.when(F.col("file") != "", F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    result = F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), F.col("index").alias("ruleIndex"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.coalesce(place, F.slice(place, 1, 0), F.array().cast(place_type())).alias("locations"),
    ))
    head = F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","version":"{VERSION}","rules":[')
    passed = checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ok"))
    tail = F.concat(F.lit(']}},"invocations":[{"executionSuccessful":'), F.col("ok").cast("string"), F.lit(',"exitCode":'), F.when(F.col("ok"), "0").otherwise("1"), F.lit('}],"results":['))
    numbered = findings.join(rules.select("rule_id", "index"), "rule_id")
    parts = [
        _fixed(checks, 0, head), _listed(rules.withColumn("ord", F.col("index")), 1, F.col("ord"), rule), passed.select(*_line(2, F.lit(0), tail)),
        _listed(numbered, 3, F.col("ord"), result), _fixed(checks, 4, F.lit("]}]}")),
    ]
    return _all(parts)


def place_type() -> str:
    return "array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint,startColumn:bigint>>>>"


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def junit_suites(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """JUnit XML: a suite a check with a case a finding, or one case where it has none."""
    counts = findings.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    known = checks.join(counts, "check", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = known.select("check", "passed", "n", F.dense_rank().over(Window.orderBy("check")).alias("suite"))  # as many rows as there are checks
    name, tests = xml_escaped(F.col("check")), F.greatest(F.col("n"), F.lit(1)).cast("string")
    failures = F.when(F.col("passed"), "0").otherwise(tests)
    open_suite = F.concat(F.lit('  <testsuite name="'), name, F.lit('" tests="'), tests, F.lit('" failures="'), failures, F.lit('" errors="0" skipped="0">'))
    empty = F.when(F.col("n") == 0, F.concat(F.lit('\n    <testcase name="'), name, F.lit(f'" classname="{TOOL}.'), name, F.lit('" />'))).otherwise("")
    # a suite's part holds its head, its cases by ord, and its tail
    suite = F.col("suite")
    heads = place.select(suite.alias("part"), F.lit(-1).cast("long").alias("ord"), F.concat(open_suite, empty).alias("value"))
    tails = place.select(suite.alias("part"), F.lit(2**62).cast("long").alias("ord"), F.lit("  </testsuite>").alias("value"))
    message, rule, file = (xml_escaped(F.col(c)) for c in ("message", "rule_id", "file"))
    failure = F.concat(F.lit('\n      <failure message="'), message, F.lit('" type="'), rule, F.lit('">'), message, F.lit(" at "), file, F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"), F.lit("</failure>"))
    case = F.concat(F.lit('    <testcase name="'), message, F.lit(f'" classname="{TOOL}.'), name, F.lit('">'), F.when(F.col("passed"), "").otherwise(failure), F.lit("\n    </testcase>"))
    cases = findings.join(place.select("check", "passed", "suite"), "check").select(suite.alias("part"), F.col("ord").cast("long").alias("ord"), case.alias("value"))
    totals = checks.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(~F.col("passed"), 1)).alias("bad"))
    first = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="{TOOL}" tests="'), F.col("all").cast("string"), F.lit('" failures="'), F.col("bad").cast("string"), F.lit('" time="0">'))
    last = _fixed(checks, 2**31 - 1, F.lit("</testsuites>"))
    return _all([totals.select(*_line(0, F.lit(0), first)), heads, cases, tails, last])


def failed_ndjson(checks: DataFrame, items: DataFrame) -> DataFrame:
    """(value): for each check that failed a JSON line an item (check, type, file, line), or one if it has none."""
    failed = checks.filter(~F.col("passed")).select("check", F.coalesce("severity", F.lit("warning")).alias("severity"), F.coalesce("rule_id", "check").alias("rule_id"), "message", F.coalesce("help", F.lit("")).alias("help"), "path")
    each = failed.join(items.select("check", F.lit(True).alias("has"), "type", "file", "line"), "check", "left")
    has = F.coalesce("has", F.lit(False))
    body = F.struct(F.col("check").alias("tool"), "severity", "rule_id", F.when(has, F.coalesce("type", "check")).otherwise(F.col("message")).alias("message"), "help", F.when(has, F.col("file")).otherwise(F.col("path")).alias("file"), F.when(has, F.col("line")).alias("line"))
    return each.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def json_report(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """A JSON document of all checks and findings, with a summary."""
    totals = checks.agg(F.count(F.lit(1)).alias("total_checks"), F.count(F.when(~F.col("passed"), 1)).alias("failed_checks"))
    passed = F.col("failed_checks") == 0
    head = F.concat(F.lit('{"passed":'), passed.cast("string"), F.lit(',"summary":'), F.to_json(F.struct("total_checks", "failed_checks")), F.lit(',"checks":['))
    order = F.dense_rank().over(Window.orderBy("check"))  # as many rows as there are checks
    listed = checks.withColumn("n", order)
    check = F.to_json(F.struct(F.col("check").alias("name"), "passed", "message", "severity", "rule_id", "help"))
    finding = F.to_json(F.struct("check", "file", "line", "column", "severity", "message", "rule_id", "fix_hint"))
    return _all([totals.select(*_line(0, F.lit(0), head)), _listed(listed, 1, F.col("n"), check), _fixed(checks, 2, F.lit('],"findings":[')), _listed(findings, 3, F.col("ord"), finding), _fixed(checks, 4, F.lit("]}"))])


def _numbered(packages: DataFrame) -> DataFrame:
    """Packages with n from 1 in the order of their purl: counted by ranges of purls, then within a range."""
    prefix = F.left("purl", F.lit(24)).alias("prefix")
    sizes = packages.groupBy(prefix).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))  # distinct prefixes only
    starts = sizes.select("prefix", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("prefix").orderBy("purl"))
    return packages.withColumn("prefix", F.left("purl", F.lit(24))).withColumn("inside", inside).join(starts, "prefix").withColumn("n", F.col("before") + F.col("inside")).drop("prefix", "inside", "before")


def cyclonedx(packages: DataFrame, name: str, version: str, timestamp: str) -> DataFrame:
    """A CycloneDX 1.4 document of packages (name, version, license, purl)."""
    tag = lambda c: F.concat(F.lit(f"      <{c}>"), xml_escaped(F.col(c)), F.lit(f"</{c}>\n"))
    unstated = F.coalesce("license", F.lit("")).isin("", "NOASSERTION")
    license_ = F.when(unstated, "      <licenses><expression>NOASSERTION</expression></licenses>\n").otherwise(F.concat(F.lit("      <licenses><license><id>"), xml_escaped(F.col("license")), F.lit("</id></license></licenses>\n")))
    body = F.concat(F.lit('    <component type="library" bom-ref="comp-'), F.col("n").cast("string"), F.lit('">\n'), tag("name"), tag("version"), license_, tag("purl"), F.lit("    </component>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<bom xmlns="http://cyclonedx.org/schema/bom/1.4" version="1">\n  <metadata>\n    <timestamp>{timestamp}</timestamp>\n    <component type="application">\n      <name>{name}</name>\n      <version>{version}</version>\n    </component>\n  </metadata>\n  <components>'
    return _all([_fixed(packages, 0, F.lit(head)), _numbered(packages).select(*_line(1, F.col("n"), body)), _fixed(packages, 2, F.lit("  </components>\n</bom>"))])


def spdx(packages: DataFrame, name: str, version: str, timestamp: str) -> DataFrame:
    """An SPDX 2.3 tag-value document of packages (name, version, license, purl)."""
    license_ = F.when(F.coalesce("license", F.lit("")) == "", "NOASSERTION").otherwise(F.col("license"))
    body = F.concat(
        F.lit("\nPackageName: "), "name", F.lit("\nSPDXID: SPDXRef-Package-"), F.col("n").cast("string"), F.lit("\nPackageVersion: "), "version", F.lit("\nPackageDownloadLocation: "), "purl",
        F.lit("\nFilesAnalyzed: false\nPackageLicenseConcluded: "), license_, F.lit("\nPackageLicenseDeclared: "), license_,
    )
    head = f"SPDXVersion: SPDX-2.3\nDataLicense: CC0-1.0\nSPDXID: SPDXRef-DOCUMENT\nDocumentName: {name}-{version}\nDocumentNamespace: https://{TOOL}/sbom/{name}-{version}-{timestamp}\nCreator: Tool: {TOOL}-{VERSION}\nCreated: {timestamp}"
    return _all([_fixed(packages, 0, F.lit(head)), _numbered(packages).select(*_line(1, F.col("n"), body))])


def write_document(document: DataFrame, path: str) -> None:
    """The document as text files whose names sort in its order."""
    document.orderBy("part", "ord").select("value").write.mode("overwrite").text(path)


# --- history and HTML ------------------------------------------------------------------------------


def health_history(runs: DataFrame, last: int) -> DataFrame:
    """(project, n, score) of each project's last runs (project, ts, passed, failed), oldest first from 0: 100 where nothing
    failed, or nothing ran, else 0."""
    latest = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("ts")))
    kept = runs.withColumn("back", latest).filter(F.col("back") <= last)
    n = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("back"))) - 1
    return kept.select("project", n.alias("n"), F.when(F.col("failed") > 0, 0).otherwise(100).alias("score"))


def sparklines(history: DataFrame, width: int = 120, height: int = 40) -> DataFrame:
    """(project, svg) of scores (project, n from 0, score): the line through them, empty for fewer than two. A project's
    scores are as many as its history was cut to."""
    pad, plot = 4.0, height - 8.0
    series = history.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "score"))), lambda p: p["score"]).alias("scores"))
    low, high = F.array_min("scores"), F.greatest(F.array_max("scores"), F.lit(1))
    span, steps = F.greatest(high - low, F.lit(1)).cast("double"), F.greatest(F.size("scores") - 1, F.lit(1))
    one = lambda c: F.format_string("%.1f", F.bround(c, 1))
    place = F.transform("scores", lambda s, i: F.struct(one(i * (F.lit(float(width)) / steps)).alias("x"), one(F.lit(pad + plot) - (s - low) / span * plot).alias("y")))
    placed = series.withColumn("p", place)
    head = f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" style="display:block">'
    half = pad + plot * 0.5
    grid = f'<line x1="0" y1="{half:g}" x2="{width}" y2="{half:g}" stroke="#e2e8f0" stroke-width="1" stroke-dasharray="3,3"/>'
    points = F.array_join(F.transform("p", lambda p: F.concat(p["x"], F.lit(","), p["y"])), " ")
    dots = F.array_join(F.transform("p", lambda p: F.concat(F.lit('<circle cx="'), p["x"], F.lit('" cy="'), p["y"], F.lit('" r="2.5" fill="#6366f1"/>'))), "")
    svg = F.concat(F.lit(head + grid + '<polyline points="'), points, F.lit('" fill="none" stroke="#6366f1" stroke-width="2" stroke-linecap="round" stroke-linejoin="round"/>'), dots, F.lit("</svg>"))
    return placed.select("project", F.when(F.size("scores") < 2, "").otherwise(svg).alias("svg"))


def html_report(project: str, findings: DataFrame, checks: DataFrame, history: DataFrame) -> DataFrame:
    """(part, ord, value): lines of an HTML page about a project, which are the page in the order of part, ord and value: head, scores so
    far, a row a check (check, passed, message), a row a finding (ord, check, file, line, severity, message), and the end.
    No section is brought together."""
    name = project.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    totals = checks.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("passed"), 1)).alias("good"))
    head = F.concat(F.lit(f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{name}</title></head><body>\n<h1>{name}</h1>\n<p>"), F.col("good").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(" checks passed</p>"))
    cell = lambda c: F.concat(F.lit("<td>"), xml_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    row = lambda *cs: F.concat(F.lit("<tr>"), *cs, F.lit("</tr>"))
    status = F.when(F.col("passed"), '<td class="pass">PASS</td>').otherwise('<td class="fail">FAIL</td>')
    parts = [
        totals.select(*_line(0, F.lit(0), head)), sparklines(history.withColumn("project", F.lit(project))).select(*_line(1, F.lit(0), F.col("svg"))),
        _fixed(checks, 2, F.lit('<table class="checks">')), checks.select(*_line(3, F.lit(0), row(cell("check"), status, cell("message")))),
        _fixed(checks, 4, F.lit('</table>\n<table class="findings">')), findings.select(*_line(5, F.col("ord"), row(*map(cell, ("severity", "check", "file", "line", "message"))))), _fixed(checks, 6, F.lit("</table>\n</body></html>")),
    ]
    return _all(parts)

