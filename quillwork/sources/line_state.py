"""What a line needs to know of the lines around it, found within each file's array of lines.

A file's lines come from one row, so that its neighbours and running states are array functions: no
shuffle and no window by file. A running state is the last event's value, and its values for all lines
are the stretches between events, repeated, which takes time in proportion to the lines.

States (columns of ``lines``), by name:

* ``before``, ``after``: the text of the line before, the trimmed line after ("" at the ends);
* ``previous``: the last trimmed line before that isn't blank ("" if none);
* ``ext``: the file's extension;
* ``in_test``: an earlier line began a test function (Rust), and none ended it;
* ``marked``: the last line before that is neither blank nor in a test function marks what follows as sensitive;
* ``section``, ``package``: the last head before in a manifest, and the line of the last package head;
* ``above``: the trimmed lines up to five before, the nearest last;
* ``head``: the trimmed line, and where it begins a function whose first bracket is still open at its end, the lines
  after it too, up to the one that closes it (or the next head);
* ``attached``: documentation stands above, with nothing but blank lines, comments and attributes between (Rust).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 5


def trim(text: Column) -> Column:
    """White space of ASCII off both ends, not just blanks."""
    return F.btrim(text, F.lit(" \t\r\n\f"))


def split_lines(files: DataFrame) -> DataFrame:
    """(path, ext, holds_test, holds_marker, ls array<string>) of files with lines: no last empty line, and none of an empty or null file. The
    array is made by a generator, which keeps later expressions from splitting the content again."""
    pieces = F.split(F.coalesce("content", F.lit("")), "\r?\n")
    holds = [F.col("content").contains("#[test]").alias("holds_test"), (F.col("content").contains("@sensitive") | F.col("content").contains("#[sensitive")).alias("holds_marker")]
    split = files.select("path", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("ext"), *holds, F.explode(F.array(pieces)).alias("ls"))
    whole = F.when(F.element_at("ls", -1) == "", F.slice("ls", 1, F.size("ls") - 1)).otherwise(F.col("ls"))
    return split.select("path", "ext", "holds_test", "holds_marker", F.explode(F.array(whole)).alias("ls")).filter(F.size("ls") > 0)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once however often it is used: as the variable of a function over one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_before(items: Column, event: Callable[[Column], Column], none: Column) -> Column:
    """For each item the value of the last event among the items before it, none if there was none; event gives
    a value, or null where there is no event."""

    def stretched(all_items: Column, seen: Column) -> Column:
        following = F.concat(F.slice(F.transform(seen, lambda s: s["i"]), 2, F.greatest(F.size(seen), F.lit(1))), F.array(F.size(all_items) - 1))
        stretches = F.transform(F.arrays_zip(seen.alias("s"), following.alias("to")), lambda z: F.array_repeat(z["s"]["v"], z["to"] - z["s"]["i"]))
        first = F.array_repeat(none, F.coalesce(F.get(seen, F.lit(0))["i"] + 1, F.size(all_items)))
        return F.concat(first, F.when(F.size(seen) > 0, F.flatten(stretches)).otherwise(F.slice(first, 1, 0)))

    def over(all_items: Column) -> Column:
        seen = F.filter(F.transform(all_items, lambda x, i: F.struct(i.alias("i"), event(x).alias("v"))), lambda s: s["v"].isNotNull())
        return once(seen, lambda found: stretched(all_items, found))

    return once(items, over)


def _switched(items: Column, on: Callable[[Column], Column], off: Callable[[Column], Column]) -> Column:
    return last_before(items, lambda x: F.when(on(x), True).when(off(x), False), F.lit(False))


def _where(holds: Column, states: Column, items: Column) -> Column:
    """States, worked out only for files that hold what switches them on at all."""
    return F.when(holds, states).otherwise(F.array_repeat(F.lit(False), F.size(items)))


def is_marker(t: Column, rust: Column) -> Column:
    return t.contains("@sensitive") | (rust & t.startswith("#[sensitive"))


def begins_test(t: Column, rust: Column) -> Column:
    return rust & t.startswith("#[test]")


#: Lines that begin a function, of the languages whose signatures are read.
HEAD = r"^(?:export )?(?:default )?(?:(?:pub(?:\([^)]*\))?|public|private|protected|static|async|unsafe|const|final|abstract|open|override) )*(?:fn|def|function|func|fun) ?\*? ?[^(]*\("


def _closed(lines: Column) -> Column:
    """How many of these lines it takes until as many brackets are closed as were opened, or all of them."""

    def step(a: Column, t: Column) -> Column:
        signs = F.regexp_replace(t, r"""\"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])'|//.*|[^()]""", "")
        opens = F.length(F.replace(signs, F.lit(")"), F.lit("")))
        depth = a["depth"] + 2 * opens - F.length(signs)
        return F.when(a["done"], a).otherwise(F.struct((depth <= 0).alias("done"), depth.alias("depth"), (a["n"] + 1).alias("n")))

    return F.aggregate(lines, F.struct(F.lit(False).alias("done"), F.lit(0).alias("depth"), F.lit(0).alias("n")), step, lambda a: a["n"])


def _heads(tr: Column) -> Column:
    """Each line, or the whole head that it begins. The lines between two heads are looked at once."""
    starts = F.filter(F.transform(tr, lambda t, i: F.when(t.rlike(HEAD), i)), lambda i: i.isNotNull())

    def from_starts(found: Column) -> Column:
        ends = F.concat(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.array(F.size(tr)))
        spans = F.transform(F.arrays_zip(found.alias("a"), ends.alias("z")), lambda x: F.slice(tr, x["a"] + 1, x["z"] - x["a"]))
        whole = F.transform(spans, lambda span: F.concat(F.array(F.array_join(F.slice(span, 1, _closed(span)), " ")), F.slice(span, 2, F.size(span))))
        return F.concat(F.slice(tr, 1, F.coalesce(F.get(found, F.lit(0)), F.size(tr))), F.flatten(whole))

    return F.when(F.exists(tr, lambda t: t.rlike(HEAD)), once(starts, from_starts)).otherwise(tr)


def _attached(tr: Column) -> Column:
    """Documentation comments and attributes count until a line of code comes between."""

    def event(t: Column) -> Column:
        documents = t.startswith("///") & ~t.startswith("////") | t.startswith("/**") & ~t.startswith("/***") | t.startswith("#[doc")
        return F.when(documents, True).when((t == "") | t.startswith("#[") | t.startswith("//") | t.startswith("*") | t.startswith("/*"), None).otherwise(False)

    return last_before(tr, event, F.lit(False))


def _states(ls: Column, tr: Column, rust: Column) -> dict[str, Column]:
    edge, n = F.array(F.lit("")), F.size(ls)
    in_test = _where(rust & F.col("holds_test"), _switched(tr, lambda t: begins_test(t, rust), lambda t: t.startswith("}")), tr)
    live = lambda x: ~x["test"] & ~begins_test(x["t"], rust)
    marked = last_before(F.arrays_zip(tr.alias("t"), in_test.alias("test")), lambda x: F.when(live(x) & (x["t"] != ""), is_marker(x["t"], rust)), F.lit(False))
    return {
        "before": F.concat(edge, F.slice(ls, 1, n - 1)),
        "after": F.concat(F.slice(tr, 2, n), edge),
        "previous": last_before(tr, lambda t: F.when(t != "", t), F.lit("")),
        "in_test": in_test,
        "marked": _where(F.col("holds_marker"), marked, tr),
        "section": last_before(tr, lambda t: F.when(t.startswith("["), t), F.lit("")),
        "package": last_before(F.transform(tr, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.when(x["t"] == "[[package]]", x["i"] + 1), F.lit(0)),
        "head": _heads(tr),
        "attached": _attached(tr),
        "above": F.transform(tr, lambda t, i: F.slice(tr, F.greatest(i - NEAR + 1, F.lit(1)), F.least(i, F.lit(NEAR)))),
    }


def arrays(files: DataFrame, *states: str) -> DataFrame:
    """(path, ext, lines array<struct<text, trimmed, and the states asked for>>) of files (path, content) with lines."""
    both = split_lines(files).select("path", "ext", "holds_test", "holds_marker", "ls", F.explode(F.array(F.transform("ls", trim))).alias("tr"))
    found = _states(F.col("ls"), F.col("tr"), F.col("ext") == "rs")
    zipped = F.arrays_zip(F.col("ls").alias("text"), F.col("tr").alias("trimmed"), *[found[s].alias(s) for s in states])
    return both.select("path", "ext", F.explode(F.array(zipped)).alias("lines"))


def lines(files: DataFrame, *states: str) -> DataFrame:
    """(path, line from 1, text, trimmed, and the states asked for) of files (path, content)."""
    if not states:
        each = split_lines(files).select("path", F.posexplode("ls").alias("at", "text"))
        return each.select("path", (F.col("at") + 1).alias("line"), "text", trim(F.col("text")).alias("trimmed"))
    each = arrays(files, *(s for s in states if s != "ext")).select("path", "ext", F.posexplode("lines").alias("at", "l"))
    return each.select("path", (F.col("at") + 1).alias("line"), *["ext" if n == "ext" else F.col(f"l.{n}").alias(n) for n in ("text", "trimmed", *states)])
