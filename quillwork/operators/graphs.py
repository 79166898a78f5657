"""Graph measures: transitive callers, cohesion, duplicated control flow."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import ranges


#: Characters of names.
_WORD = r"[\p{L}\p{N}_]+"
#: A table of callers is at most half as large as the one before, else the two are merged.
_MERGE = 2


def call_edges(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, caller, callee) of lines (path, line, text, trimmed) and functions (file, name, line, end_line): a line
    of a function that calls, qualifies or borrows another function of its file by name; comments and bindings don't
    count. A name counts wherever it is found: at the end of what stands before a bracket or two colons, or at the
    beginning of what is borrowed. So all endings (or beginnings) of such words are keys that meet names by (file, name),
    and lines meet the functions around them by (file, bucket of lines)."""
    live = lines.filter(~F.col("trimmed").startswith("//") & ~F.col("trimmed").startswith("let "))
    called = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"({_WORD})(?=\(|::)"), 1))
    borrowed = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"&mut ({_WORD})"), 1))
    endings = F.flatten(F.transform(called, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.right(w, n))))
    beginnings = F.flatten(F.transform(borrowed, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.left(w, n))))
    words = live.select(F.col("path").alias("file"), "line", F.explode(F.array_distinct(F.concat(endings, beginnings))).alias("callee"))
    named = ranges.dealt(words).join(functions.select("file", F.col("name").alias("callee")).distinct(), ["file", "callee"])
    spans = functions.select("file", F.col("name").alias("caller"), F.col("line").alias("first"), F.col("end_line").alias("last")).withColumn("bucket", ranges.buckets(F.col("first"), F.col("last")))
    within = ranges.dealt(named.withColumn("bucket", F.floor(F.col("line") / ranges.LINES))).join(spans, ["file", "bucket"]).filter(F.col("line").between(F.col("first"), F.col("last")))
    return within.filter("caller <> callee").select("file", "caller", "callee").distinct()


def transitive_callers(calls: DataFrame, changed: DataFrame) -> DataFrame:
    """(name, depth): changed functions (name) at 0, and all that call them directly or not. calls may hold cycles:
    each round keeps only callers that are new, and rounds end when there are none. What was found is a few tables in
    the shared folder: a round's callers are one, and tables are merged when the next is about as large, so that a row
    is written again a few times at most, however long the chain is."""
    calls = scratch.held(calls.select("caller", "callee").distinct())
    front = scratch.held(changed.select("name").distinct().withColumn("depth", F.lit(0)))
    size, done = front.count(), []
    for depth in count(1):
        up = calls.join(front, calls["callee"] == front["name"]).select(calls["caller"].alias("name")).distinct()
        for _, t in (*done, (size, front)):
            up = up.join(t, "name", "left_anti")
        after = scratch.held(up.withColumn("depth", F.lit(depth)))
        done.append((size, front))
        size, front = after.count(), after
        if not size:
            scratch.release(after, calls)
            return reduce(DataFrame.unionByName, [t for _, t in done])
        while len(done) > 1 and done[-2][0] < _MERGE * done[-1][0]:
            done[-2:] = [_merged(done[-2:])]


def _merged(parts: list[tuple[int, DataFrame]]) -> tuple[int, DataFrame]:
    both = parts[0][1].unionByName(parts[1][1])
    one = scratch.held(both.coalesce(both.sparkSession.sparkContext.defaultParallelism))
    scratch.release(*(t for _, t in parts))
    return sum(n for n, _ in parts), one


def lcom4(fields: DataFrame) -> DataFrame:
    """(path, type, methods, components) of (path, type, method, field): methods that share a field, or
    have none; types of one method are left out. A use of a field by a method is a set of the two, and within a type,
    which is small, each set takes in those before it that it meets."""
    method = F.coalesce(F.concat(F.lit("m"), "method"), F.lit(""))  # a set holds no null
    pair = F.array_compact(F.array(method, F.concat(F.lit("f"), "field")))
    uses = fields.groupBy("path", "type").agg(F.collect_set(pair).alias("uses"))

    def take(done: Column, new: Column) -> Column:
        meets = lambda s: F.arrays_overlap(s, new)
        return F.concat(F.filter(done, lambda s: ~meets(s)), F.array(F.array_distinct(F.flatten(F.concat(F.filter(done, meets), F.array(new))))))

    apart = F.aggregate("uses", F.array().cast("array<array<string>>"), take)
    each = uses.withColumn("methods", F.size(F.array_distinct(F.transform("uses", lambda u: u[0])))).filter("methods > 1")
    return each.select("path", "type", "methods", F.size(apart).alias("components"))


# The control-flow tokens, a bit of a mask each.
TOKENS = ("IF", "ELSE", "WHILE", "FOR", "LOOP", "MATCH", "ARM", "LET", "RET", "CALL", "LAMBDA", "BLOCK", "TRY")


def duplicate_groups(prints: DataFrame, least: float = 0.7, min_tokens: int = 5, names: tuple[str, ...] = TOKENS) -> DataFrame:
    """(ord, group): functions (ord, tokens array) whose token sets have a Jaccard similarity to a group's
    first member; each joins the earliest group it fits. names: what tokens there are, thirteen as a rule.

    A set is a mask of a bit a token, and masks are ordered by their first function. Two masks that are alike differ in a
    few bits, so all that a mask may be like are its own with those bits turned, which meet by equality. Rounds settle
    them: a mask before which no undecided mask is like it leads a group, and those like a leader belong to their
    earliest one once nothing earlier is undecided. Of thirteen tokens there are 8,191 masks at most, and a round settles the first at least.
    """
    kept = prints.filter(F.size("tokens") >= min_tokens)
    bit = F.create_map(*[x for i, t in enumerate(names) for x in (F.lit(t), F.lit(1 << i))])
    mask = F.aggregate(F.array_distinct("tokens"), F.lit(0), lambda a, t: a.bitwiseOR(F.coalesce(F.try_element_at(bit, t), F.raise_error(F.concat(F.lit("not a token: "), t)).cast("int"))))
    masked = scratch.held(kept.select("ord", mask.alias("mask")))  # what makes the tokens runs once, not for each use
    masks = masked.groupBy("mask").agg(F.min("ord").alias("first"))
    most = int((1 - least) * len(names))
    turned = [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(len(names)), k)]
    spread = masks.select("mask", "first", F.explode(F.transform(F.array(*map(F.lit, turned)), lambda x: F.col("mask").bitwiseXOR(x))).alias("other"))
    like = spread.join(masks.select(F.col("mask").alias("other"), F.col("first").alias("before")), "other").filter(F.col("before") < F.col("first"))
    shared, all_bits = F.bit_count(F.col("mask").bitwiseAND(F.col("other"))), F.bit_count(F.col("mask").bitwiseOR(F.col("other")))
    pairs = scratch.held(like.filter(shared / all_bits >= least).select("mask", "other"))
    state = scratch.held(masks.withColumn("group", F.lit(None).cast(masks.schema["first"].dataType)))
    while not state.filter("group is null").isEmpty():
        other = state.select(F.col("mask").alias("other"), F.col("group").alias("theirs"), F.col("first").alias("before"))
        seen = state.filter("group is null").join(pairs, "mask", "left").join(other, "other", "left")
        leads = F.col("theirs") == F.col("before")
        undecided = F.min(F.when(F.col("other").isNotNull() & F.col("theirs").isNull(), F.col("before")))
        seen = seen.groupBy("mask", "first").agg(undecided.alias("wait"), F.min(F.when(leads, F.col("theirs"))).alias("leader"))
        settled = F.when(F.col("leader").isNotNull() & (F.col("wait").isNull() | (F.col("leader") < F.col("wait"))), F.col("leader")).when(F.col("wait").isNull(), F.col("first"))
        after = scratch.held(state.filter("group is not null").unionByName(seen.select("mask", "first", settled.alias("group"))))
        scratch.release(state)
        state = after
    scratch.release(pairs)
    return masked.join(state.select("mask", "group"), "mask").select("ord", "group")
