"""The surface for checks and rules of one's own: a protocol, a registry, and rule packs as tables.

A check makes findings from a context, lazily; ``run_checks`` puts the findings of many together, and a check
that can't be built gives a row that says so instead of ending the run. A rule pack is a table of rules, of any
length, that lines are matched with by an automaton.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "file string, line int, rule_id string, category string, severity string"


@dataclass
class Context:
    """What a check may read: named tables, such as files and lines, made when they are asked for."""

    spark: SparkSession
    tables: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]()


class Check(Protocol):
    name: str

    def findings(self, context: Context) -> DataFrame:
        """(file, line, rule_id, category, severity)"""


@dataclass
class FunctionCheck:
    """A check made from a function of the context."""

    name: str
    make: Callable[[Context], DataFrame]

    def findings(self, context: Context) -> DataFrame:
        return self.make(context)


class Registry:
    """Checks by name, in the order in which they were added; a later one of the same name takes its place."""

    def __init__(self):
        self.checks: dict[str, Check] = {}

    def add(self, check: Check) -> Check:
        self.checks[check.name] = check
        return check

    def check(self, name: str) -> Callable[[Callable[[Context], DataFrame]], FunctionCheck]:
        return lambda make: self.add(FunctionCheck(name, make))


def run_checks(registry: Registry, context: Context, only: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Findings of all checks (check, file, line, rule_id, category, severity), and results (check, available,
    error): a check whose tables aren't there is skipped."""
    found, states = context.spark.createDataFrame([], f"check string, {FINDING}"), []
    for name, check in registry.checks.items():
        if only and name not in only:
            continue
        try:
            mine = check.findings(context).select(F.lit(name).alias("check"), "file", F.col("line").cast("int").alias("line"), "rule_id", "category", "severity")
        except (KeyError, ValueError) as missing:
            states.append((name, False, f"not available: {missing}"))
            continue
        found = found.unionByName(mine)
        states.append((name, True, None))
    return found, context.spark.createDataFrame(states, "check string, available boolean, error string")


def pack_findings(lines: DataFrame, pack: DataFrame) -> DataFrame:
    """(file, line, rule_id, category, severity): the first rule of a pack (ord, rule_id, category, severity, pattern, also)
    that a line (path, line, text) holds; it holds also as well, unless that is empty. A null pattern matches nothing.

    All patterns are one automaton, which a line goes through once however many rules there are. A pack is configuration:
    its rules are shipped to workers once, as a broadcast of their texts.
    """
    spark = lines.sparkSession
    rows = pack.filter("pattern is not null").orderBy("ord").select("rule_id", "category", "severity", "pattern", F.coalesce("also", F.lit("")).alias("also")).collect()
    shipped, key = spark.sparkContext.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = rule_matcher(key, shipped.value)
        for batch in batches:
            path, line, text = batch.columns
            hits = [matcher.first(t) for t in text.to_pylist()]
            at = pa.array([i for i, h in enumerate(hits) if h is not None], pa.int64())
            found = list(zip(*(matcher.rules[h][:3] for h in hits if h is not None), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([path.take(at).cast(pa.string()), line.take(at).cast(pa.int32()), *[pa.array(c, pa.string()) for c in found]], names=["file", "line", "rule_id", "category", "severity"])

    return lines.select("path", F.col("line").cast("int").alias("line"), "text").filter("text is not null").mapInArrow(run, FINDING)


class RuleMatcher:
    """The first rule that a text holds, by one automaton over all patterns."""

    def __init__(self, rules: list[tuple]):
        import ahocorasick

        self.rules, self.always, numbers = rules, [], {}
        for n, rule in enumerate(rules):
            (numbers.setdefault(rule[3], []) if rule[3] else self.always).append(n)
        self.patterns = ahocorasick.Automaton()
        for pattern, which in numbers.items():
            self.patterns.add_word(pattern, which)
        if numbers:
            self.patterns.make_automaton()

    def first(self, text: str) -> int | None:
        met = {id(which): which for _, which in self.patterns.iter(text)} if len(self.patterns) else {}
        for n in heapq.merge(self.always, *met.values()):
            if self.rules[n][4] in text:
                return n
        return None


_matchers: dict[str, RuleMatcher] = {}


def rule_matcher(key: str, rules: list[tuple]) -> RuleMatcher:
    """One a worker process, kept over its tasks as long as they are of the same pack."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = RuleMatcher(rules)
    return _matchers[key]


def by_control(findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """(control, n) of findings by the controls (control, rule_id) that their rules belong to."""
    return findings.join(mapping, "rule_id").groupBy("control").agg(F.count(F.lit(1)).alias("n"))
