"""Scalar functions that reports and scanners share.

Widths count display columns: wide East Asian characters and emoji take two, combining marks none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of characters of two columns and of none (Unicode East Asian width and marks).
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"
NONE = r"[\p{Mn}\p{Me}\p{Cf}\x{00}-\x{1F}\x{7F}-\x{9F}]"
ELLIPSIS = "…"


def width(text: Column) -> Column:
    """Display columns of a text."""
    return F.length(text) + F.regexp_count(text, F.lit(WIDE)) - F.regexp_count(text, F.lit(NONE))


def _fitting(text: Column, most: Column, from_end: bool) -> Column:
    """As many characters from one end as fit into so many columns."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    chars = F.reverse(chars) if from_end else chars
    start = F.struct(F.lit(0).alias("cols"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(at: Column, c: Column) -> Column:
        more = at["cols"] + width(c)
        fits = at["open"] & (more <= most)
        return F.struct(F.when(fits, more).otherwise(at["cols"]).alias("cols"), F.when(fits, at["n"] + 1).otherwise(at["n"]).alias("n"), fits.alias("open"))

    return F.aggregate(chars, start, step, lambda at: at["n"])


def truncate_left(text: Column, most: int) -> Column:
    """The start of a text and an ellipsis if it takes more than so many columns."""
    kept = F.left(text, _fitting(text, F.lit(max(most - 1, 0)), False))
    return F.when(width(text) <= most, text).otherwise(F.concat(kept, F.lit(ELLIPSIS)) if most else F.lit(""))


def truncate(text: Column, most: int) -> Column:
    """An ellipsis and the end of a text if it takes more than so many columns."""
    kept = F.right(text, _fitting(text, F.lit(max(most - 1, 0)), True))
    return F.when(width(text) <= most, text).otherwise(F.concat(F.lit(ELLIPSIS), kept) if most else F.lit(""))


def first_line_with(content: Column, pattern: Column) -> Column:
    """The number of the first line that holds a pattern, 1 if none does."""
    before = F.substring_index(content, pattern, 1) if isinstance(pattern, str) else F.when(F.instr(content, pattern) > 0, F.left(content, F.instr(content, pattern) - 1)).otherwise(F.lit(""))
    return F.size(F.split(before, "\n"))


def quoted(text: Column) -> Column:
    """What stands in the first pair of double quotes, null if there is none."""
    return F.nullif(F.regexp_extract(text, '"([^"]*)"', 0), F.lit("")).substr(F.lit(2), F.length(F.regexp_extract(text, '"([^"]*)"', 1)))


def keyword_import(text: Column, keyword: str) -> Column:
    """What follows a keyword at the start, without semicolons at the end; null if nothing does."""
    rest = F.trim(F.regexp_replace(F.substr(F.trim(text), F.lit(len(keyword) + 1)), ";+$", ""))
    return F.when(F.trim(text).startswith(keyword) & (rest != ""), rest)


def occurrences(text: Column, part: Column) -> Column:
    """How often part stands in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def without_repeats(values: Column) -> Column:
    """An array without elements that equal the one before."""
    before = F.concat(F.slice(values, 1, 0), F.array(F.lit(None)), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))))
    each = F.arrays_zip(values.alias("v"), before.alias("b"))
    return F.transform(F.filter(each, lambda x: ~x["v"].eqNullSafe(x["b"]) | x["b"].isNull()), lambda x: x["v"])


def json_value(content: Column, path: str, default: str) -> Column:
    """The value at a path of a JSON text, default where there is none."""
    return F.coalesce(F.get_json_object(content, path), F.lit(default))


# Phases by what a rule's name holds, the first that applies.
PHASES = (
    (("observability",), "§7 Support / §4.5 Tracing"), (("debuggability", "contextless-unwrap"), "§6.6 Debug / §4.5 Tracing"),
    (("test-quality", "test_quality", "nondeterminism"), "§6 Test"), (("design-docs", "design_docs"), "§3 Design"), (("doccov",), "§3 Design / §4 Code"),
    (("errhandle", "unwrap"), "§7 Support / §4 Code"),
)
OTHER_PHASE = "§4 Code"


def phase(rule_id: Column) -> Column:
    """The phase of development that a rule belongs to."""
    low, chain = F.lower(rule_id), F
    for words, name in PHASES:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        chain = chain.when(hit, name)
    return chain.otherwise(OTHER_PHASE)


def severity_score(severity: Column) -> Column:
    """0 for info to 4 for critical; null for what is none of the five."""
    chain = F
    for n, name in enumerate(("info", "low", "medium", "high", "critical")):
        chain = chain.when(F.lower(severity) == name, n)
    return chain
