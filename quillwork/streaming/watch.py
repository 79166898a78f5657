"""Continuous re-evaluation: watched folders, differences between cycles, and windows over events."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scoring import difference


def watch_files(spark: SparkSession, folder: str, each: Callable[[DataFrame, int], None], checkpoint: str, debounce: str = "2 seconds"):
    """Call each(files, cycle) with the text files (path, content) that came since the last trigger."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=debounce).start()


def debounced(run: Callable[[DataFrame, int], None], wait: float, clock: Callable[[], float] = time.monotonic) -> Callable[[DataFrame, int], None]:
    """run, but for cycles that come within so many seconds after the last one that ran: they are dropped."""
    last: list[float] = []

    def maybe(batch: DataFrame, cycle: int) -> None:
        now = clock()
        if not last or now - last[0] >= wait:
            last[:] = [now]
            run(batch, cycle)

    return maybe


def full_cycles(read: Callable[[SparkSession], DataFrame], checks: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that, whenever something has changed, runs the checks over the whole tree again:
    read gives all files, checks their results, and changed files only decide that there is a cycle."""

    def run(batch: DataFrame, cycle: int) -> None:
        if not batch.isEmpty():
            emit(checks(read(batch.sparkSession)), cycle)

    return run


def check_events(findings: DataFrame, results: DataFrame) -> DataFrame:
    """(kind, check, payload JSON) of a run as events: a finding each, a rule that is complete, and the end."""
    each = findings.select(F.lit("finding").alias("kind"), "check", F.to_json(F.struct("file", "line", "rule_id", "severity")).alias("payload"))
    counts = findings.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    done = results.join(counts, "check", "left").select(F.lit("rule_complete").alias("kind"), "check", F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias("findings"), "available")).alias("payload"))
    end = results.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("checks"))).alias("payload")).select(F.lit("end").alias("kind"), F.lit(None).cast("string").alias("check"), "payload")
    return each.unionByName(done).unionByName(end)


def ordered_events(findings: DataFrame, results: DataFrame) -> DataFrame:
    """(ord, step, kind, check, file, line, payload) of a run as the events that a client gets, in the order of ord, step, file and
    line: by check its findings, that it is complete, and how far the run has come; then the end. findings: check,
    file, line, rule_id, severity; results: check, available."""
    counts = findings.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    done = results.join(counts, "check", "left").select("check", "available", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = done.withColumn("ord", F.row_number().over(Window.orderBy("check")))  # as many rows as there are checks
    total = results.agg(F.count(F.lit(1)).alias("total"))  # one row
    nowhere = [F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line")]
    found = findings.join(ranked.select("check", "ord"), "check").select("ord", F.lit(0).alias("step"), F.lit("finding").alias("kind"), "check", "file", F.col("line").cast("int").alias("line"), F.to_json(F.struct("file", "line", "rule_id", "severity")).alias("payload"))
    complete = ranked.select("ord", F.lit(1).alias("step"), F.lit("rule_complete").alias("kind"), "check", *nowhere, F.to_json(F.struct(F.col("n").alias("findings"), "available")).alias("payload"))
    progress = ranked.crossJoin(total).select("ord", F.lit(2).alias("step"), F.lit("progress").alias("kind"), "check", *nowhere, F.to_json(F.struct(F.col("ord").alias("completed"), "total")).alias("payload"))
    end = done.agg(F.count(F.lit(1)).alias("checks"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings")).select((F.col("checks") + 1).cast("int").alias("ord"), F.lit(3).alias("step"), F.lit("end").alias("kind"), F.lit(None).cast("string").alias("check"), *nowhere, F.to_json(F.struct("checks", "findings")).alias("payload"))
    return found.unionByName(complete).unionByName(progress).unionByName(end)


#: Events that a client may have been sent without having taken them.
CAPACITY = 100


def deliver(events: DataFrame, send: Callable[[list], None], capacity: int = CAPACITY) -> dict[str, int]:
    """Send ordered_events to a client in their order, capacity at most at a time: the next ones are fetched when send has
    come back. Partitions come to the driver one by one. Gives counts by kind."""
    counts, held = Counter(), []

    def flush() -> None:
        if held:
            send(list(held))
            counts.update(r["kind"] for r in held)
            held.clear()

    for row in events.orderBy("ord", "step", "file", "line", "payload").toLocalIterator():
        held.append(row)
        if len(held) == capacity:
            flush()
    flush()
    return dict(counts)


def write_events(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events as JSON lines."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def filtered(events: DataFrame, severities: tuple[str, ...] = (), rules: tuple[str, ...] = ()) -> DataFrame:
    """Events (severity, rule_id, ...) that a client asked for; works on streams and on tables."""
    kept = events.filter(F.col("severity").isin(*severities)) if severities else events
    return kept.filter(F.col("rule_id").isin(*rules)) if rules else kept


def cycle_difference(state_path: str, key: list[str], emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: checks (key, passed) of a cycle against the state table of the last; a
    repeated cycle reads the same state, since each cycle writes its own folder."""

    def run(batch: DataFrame, cycle: int) -> None:
        spark = batch.sparkSession
        now = batch.groupBy(*key).agg(F.bool_and("passed").alias("passed"))
        before = spark.read.parquet(f"{state_path}/cycle={cycle - 1}") if cycle else now.limit(0)
        changed = difference(before.select(*key, "passed"), now, key)
        emit(changed.filter(F.col("status").isin("regressed", "improved")), cycle)
        kept = before.select(*key, "passed").join(now, key, "left_anti").unionByName(now)
        kept.write.mode("overwrite").parquet(f"{state_path}/cycle={cycle}")

    return run


FIXED, BROKEN = "fail_to_pass", "pass_to_fail"


def changes(checks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key..., order..., change) of a table of all cycles (key..., order..., passed): where a key passes and didn't before,
    or the other way round."""
    before = F.lag("passed").over(Window.partitionBy(*key).orderBy(*order))
    changed = checks.withColumn("was", before).filter("was <> passed")
    return changed.select(*key, *order, F.when(F.col("passed"), FIXED).otherwise(BROKEN).alias("change"))


class CycleState(StatefulProcessor):
    """What a key's last cycle came to, a boolean a key; it may expire."""

    def __init__(self, key: list[str], order: list[str], ttl_ms: int | None):
        self.key, self.order, self.ttl_ms = key, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getValueState("passed", "passed boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = pd.concat(list(rows)).groupby(self.order, as_index=False, sort=True)["passed"].all()  # a key's cycles since the last trigger
        was = pd.Series([self.passed.get()[0] if self.passed.exists() else None, *seen["passed"][:-1]], dtype=object)
        self.passed.update((bool(seen["passed"].iloc[-1]),))
        changed = seen[[w is not None and bool(w) != bool(p) for w, p in zip(was, seen["passed"], strict=True)]]
        if len(changed):
            out = changed[self.order].copy()
            for at, (name, value) in enumerate(zip(self.key, key, strict=True)):
                out.insert(at, name, value)
            out["change"] = [FIXED if p else BROKEN for p in changed["passed"]]
            yield out

    def close(self) -> None:
        pass


def stateful_changes(checks: DataFrame, key: list[str], order: list[str], ttl_ms: int | None = None) -> DataFrame:
    """changes of a stream, or of a table: the state of the last cycle is kept by key between triggers, across restarts
    from a checkpoint, and expires after ttl_ms. Cycles of one trigger are taken in order; one that comes late is compared
    with the last one seen. A task holds a key's cycles of one trigger; checks of one cycle are one row before that where
    the input is a table."""
    spark = checks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given = checks.select(*key, *order, "passed")
    if not checks.isStreaming:
        _ = spark.streams.active  # starts the coordinator of state stores, which a table needs too
        given = given.groupBy(*key, *order).agg(F.bool_and("passed").alias("passed"))
    out = given.select(*key, *order).schema.add("change", "string")
    return given.groupBy(*key).transformWithStateInPandas(CycleState(key, order, ttl_ms), out, "Update", "None" if ttl_ms is None else "ProcessingTime")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows over events (ts timestamp, event_type, value);
    works on streams and on tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, n) of windows that overlap, over events (ts timestamp)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def followed(first: DataFrame, then: DataFrame, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, at, after) of events (user_id, ts) that another of the same user follows in that time; of streams,
    rows are kept as long as the watermarks allow a match."""
    a = first.select(F.col("user_id").alias("u1"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    b = then.select(F.col("user_id").alias("u2"), F.col("ts").cast("timestamp").alias("after")).withWatermark("after", late)
    near = F.expr(f"u1 = u2 AND after > at AND after <= at + INTERVAL {within}")
    return a.join(b, near).select(F.col("u1").alias("user_id"), "at", "after")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
