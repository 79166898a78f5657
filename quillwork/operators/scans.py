"""Line scanners: ordered literal rules compiled to one CASE, and line state by windows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import extension
from . import rule_tables as tables
from .rule_tables import Rule

SAST_EXTENSIONS = ("rs", "py", "js", "ts", "tsx", "go", "java", "cs", "php", "rb", "sol")
CRYPTO_EXTENSIONS = SAST_EXTENSIONS[:-1]
ACCESS_EXTENSIONS = (*CRYPTO_EXTENSIONS, "sh", "yaml", "yml", "json", "toml")
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
#: Brackets within brackets that arguments of a route call may hold.
NESTED = 8

# Literal patterns of the observability and test quality checks.
RAW_LOGS = ("println!(", "eprintln!(", "console.log(", "console.error(", "console.warn(", "fmt.Println(", "fmt.Printf(", "fmt.Fprintf(", "System.out.println(", "print(", "puts(")
NONDETERMINISM = ("SystemTime::now()", "Instant::now()", "thread::sleep(", "time.sleep(", "Time.now", "Date.now()", "new Date()", "Math.random()", "random.random()", "rand()", "time.Now()", "os.Getpid()")


def first_match(text: Column, rules: Sequence[Rule]) -> Column:
    """Number of the first rule whose literals the text contains, null if none: one CASE, no join."""
    chain = None
    for i, r in enumerate(rules):
        hit = text.contains(r.pattern)
        hit = hit & text.contains(r.also) if r.also else hit
        chain = F.when(hit, i) if chain is None else chain.when(hit, i)
    return F.lit(None).cast("int") if chain is None else chain


def attribute(number: Column, rules: Sequence[Rule], name: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(r, name)) for r in rules]), number + 1)


def findings(lines: DataFrame, rules: Sequence[Rule], text: Column | None = None) -> DataFrame:
    """(file, line, rule_id, category, severity)."""
    hits = lines.withColumn("rule", first_match(F.col("text") if text is None else text, rules)).filter(F.col("rule").isNotNull())
    return described(hits, rules)


def described(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(file, line, rule_id, category, severity) of hits (path, line, rule: a rule's number)."""
    n = F.col("rule")
    return hits.select(F.col("path").alias("file"), "line", attribute(n, rules, "id").alias("rule_id"), attribute(n, rules, "category").alias("category"), attribute(n, rules, "severity").alias("severity"))


def live_hits(lines: DataFrame, rule: Column) -> DataFrame:
    """(path, line, rule) of the lines with a rule that neither open nor stand in a block comment. Rules are matched
    first, so that the window by file sees hits and the lines that open or close a comment, and no text."""
    t = F.col("trimmed")
    event = F.when(t.startswith("/*") & ~t.contains("*/"), True).when(t.contains("*/"), False)
    rows = lines.select("path", "line", event.alias("event"), F.when(~t.startswith("/*"), rule).alias("rule")).filter("event is not null or rule is not null")
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit(False))
    return rows.withColumn("inside", inside).filter("not inside and rule is not null").select("path", "line", "rule")


def before_tests(lines: DataFrame, begins: Column, keep: list[str]) -> DataFrame:
    """Rows of lines that have a hit (a column, not null) and come before the line where tests begin in their file:
    again only hits and such lines go through the window."""
    rows = lines.select("path", "line", *keep, "hit", begins.alias("begins")).filter("begins or hit is not null")
    seen = F.bool_or("begins").over(Window.partitionBy("path").orderBy("line"))
    return rows.withColumn("seen", seen).filter("not seen and hit is not null").select("path", "line", *keep, "hit")


def knowing(lines: DataFrame, *states: str) -> DataFrame:
    """lines with the line before or after, of those that ``corpus.lines`` was asked for, or else by a window."""
    by_line = Window.partitionBy("path").orderBy("line")
    windowed = {"after": F.lead("trimmed", 1, "").over(by_line), "before": F.lag("text", 1, "").over(by_line)}
    return lines.withColumns({s: windowed[s] for s in states if s not in lines.columns})


def opens_docstring() -> Column:
    t = F.col("trimmed")
    return (extension(F.col("path")) == "py") & (t.startswith("'''") | t.startswith('"""'))


def in_extensions(lines: DataFrame, extensions: Sequence[str]) -> DataFrame:
    return lines.filter(extension(F.col("path")).isin(*extensions))


def sast(lines: DataFrame, min_confidence: str = "low") -> DataFrame:
    rules = [r for r in tables.SAST if CONFIDENCE.get(r.confidence, 1) >= CONFIDENCE.get(min_confidence, 1)]
    rule = F.when(~F.col("trimmed").rlike("^(//|#|--|<!--|;|%)") & ~opens_docstring(), first_match(F.col("text"), rules))
    return described(live_hits(in_extensions(lines, SAST_EXTENSIONS), rule), rules)


SEVERITY_ORDER = ("critical", "high", "medium")


def by_severity(found: DataFrame) -> DataFrame:
    """Findings in the order of a report: most severe first, then by file and line."""
    chain = F
    for i, name in enumerate(SEVERITY_ORDER):
        chain = chain.when(F.col("severity") == name, i)
    return found.orderBy(chain.otherwise(len(SEVERITY_ORDER)), "file", "line")


def at_least(found: DataFrame, severity: str) -> DataFrame:
    """Findings of that severity or above: low holds all, medium leaves low out, high only itself and critical."""
    rank = {"critical": 3, "high": 2, "medium": 1}
    mine = F.coalesce(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("severity")], F.lit(0))
    return found.filter(mine >= min(rank.get(severity, 0), 2))


def crypto(lines: DataFrame) -> DataFrame:
    return findings(in_extensions(lines, CRYPTO_EXTENSIONS).filter(~F.col("trimmed").rlike(r"^(//|#|\*)")), tables.CRYPTO)


LITERAL_ACCESS = tuple(r for r in tables.ACCESS_CONTROL if r.category != "missing_auth")
#: Lines that define a rule rather than break it.
RULE_TEXT = "^(pattern|description|remediation|rule_id|severity|also):"


def app_wide_auth(lines: DataFrame) -> DataFrame:
    """One row (auth boolean): whether any line of the project registers authentication middleware."""
    t = F.col("text")
    hit = reduce(or_, [t.contains(p) for p in tables.AUTH_MIDDLEWARE]) & ~F.col("trimmed").startswith("//")
    return lines.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("auth"))


def is_public_route(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [low.contains(k) for k in tables.PUBLIC_ROUTES])


def has_inline_auth(text: Column) -> Column:
    """A guard on the line, or a route call with three arguments or more: what stands in brackets and in quotes
    is taken out from the inside, and two commas are left before the call's own bracket."""
    low = F.lower(text)
    hit = text.contains("@UseGuards(") | (text.contains("route_layer(") & low.contains("auth"))
    for method in tables.ROUTE_METHODS:
        call = F.regexp_extract(low, rf"^.*?{re.escape(method)}(.*)$", 1)
        plain = F.regexp_replace(call, "\"[^\"]*(\"|$)|'[^']*('|$)", "")
        for _ in range(NESTED):
            plain = F.regexp_replace(plain, r"\([^()]*\)", "")
        # a bracket that nothing closes hides what follows it
        own = F.regexp_replace(F.regexp_extract(plain, r"^([^)]*)", 1), r"\(.*$", "")
        # most lines hold no method, and what follows one is worked out once
        hit = hit | (low.contains(method) & (F.regexp_count(own, F.lit(",")) >= 2))
    return hit


def access_control(lines: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(file, line, rule_id, category, severity) outside comments, attributes not counted as such; the first rule
    that applies wins. A route without authentication isn't reported if the project registers middleware
    (context, from app_wide_auth), if the line guards it, or if it is public. Without context the rules for
    routes are left out."""
    t, text = F.col("trimmed"), F.col("text")
    comment = t.rlike("^(//|--|<!--|;|%)") | (t.startswith("#") & ~t.rlike(r"^#[\[!#]")) | opens_docstring()
    live = ~comment & ~t.rlike(RULE_TEXT)
    if context is None:
        return described(live_hits(lines, F.when(live, first_match(text, LITERAL_ACCESS))), LITERAL_ACCESS)
    auth_rules = [r for r in tables.ACCESS_CONTROL if r.category == "missing_auth"]
    # middleware clears every route but the public ones, and those are exempt: with it no route is left
    known = lines.crossJoin(F.broadcast(context))  # context: one row
    route = first_match(text, auth_rules)
    open_route = F.when(route.isNotNull() & ~F.col("auth") & ~is_public_route(text) & ~has_inline_auth(text), route)
    literal = first_match(text, LITERAL_ACCESS) + len(auth_rules)
    return described(live_hits(known, F.when(live, F.coalesce(open_route, literal))), [*auth_rules, *LITERAL_ACCESS])


def secret_assignments(lines: DataFrame) -> DataFrame:
    """Keyword patterns on lower-cased lines that hold an assignment."""
    return findings(lines.filter(F.col("text").contains("=") | F.col("text").contains(":")), tables.SECRETS, F.lower("text"))


ERROR_EXTENSIONS = ("rs", "go", "py", "js", "ts", "tsx")


#: Findings that aren't patterns of Rust, in the order of their numbers.
OTHER_ERRORS = (
    ("discard", "low"), ("bare_except", "high"), ("empty_catch", "medium"), ("empty_catch", "high"), ("discard", "medium"), ("empty_error_handler", "high"),
)


def error_handling(lines: DataFrame, include_tests: bool = False) -> DataFrame:
    """Patterns by language, in one pass; what follows a test module in a file is skipped unless it is asked for, and so
    are comments. A Rust line gives its first pattern, and a discarded value besides; a line of another language gives one
    finding at most. Empty handlers show on the line after, which the last line of a file has as empty."""
    t, text, after, ext = F.col("trimmed"), F.col("text"), F.col("after"), F.col("ext")
    rules = [*tables.ERRORS, *(Rule(name, "error_handling", "high", severity, "", "") for name, severity in OTHER_ERRORS)]
    discard, bare, swallowed, empty, dropped, unhandled = range(len(tables.ERRORS), len(rules))
    if "ext" not in lines.columns:  # by a generator, so that later expressions don't match the path again
        lines = lines.select("*", F.explode(F.array(extension(F.col("path")))).alias("ext"))
    seen = knowing(lines.filter(ext.isin(*ERROR_EXTENSIONS)), "after")
    script = F.when(t.contains(".catch(") & (t.contains("{}") | t.endswith(".catch()")), swallowed).when((t == "} catch (e) {") & (after == "}"), empty)
    go = F.when(t.startswith("_ =") | t.startswith("_, _ ="), dropped).when(t.startswith("if err != nil {") & (after == "}"), unhandled)
    python = F.when(t.isin("except:", "except Exception:", "except Exception as e:") & after.isin("pass", ""), bare)
    live = ~t.startswith("//") & ~t.startswith("#")
    rule = F.when(ext == "rs", first_match(text, tables.ERRORS)).when(ext == "py", python).when(ext == "go", go).otherwise(script)
    # what a line gives is one number: its rule, and above all rules a discarded value besides
    both, n = (ext == "rs") & t.startswith("let _ ="), len(rules)
    hit = F.when(live, F.when(both, F.coalesce(rule + 1, F.lit(0)) + n).otherwise(rule))
    hits = before_tests(seen.withColumn("hit", hit), F.lit(False) if include_tests else t.contains("#[cfg(test)]") | t.contains("mod tests"), [])
    each = F.when(F.col("hit") < n, F.array("hit")).when(F.col("hit") == n, F.array(F.lit(discard))).otherwise(F.array(F.col("hit") - n - 1, F.lit(discard)))
    return described(hits.select("path", "line", F.explode(each).alias("rule")), rules)


def debt_markers(lines: DataFrame) -> DataFrame:
    """(file, line, marker) of comment lines that start //, /* or *: every marker on a line counts."""
    comments = lines.filter(F.col("trimmed").rlike(r"^(//|/\*|\*)"))
    each = comments.withColumn("marker", F.explode(F.array(*[F.lit(m) for m in tables.DEBT_CHECK])))
    return each.filter(F.expr("contains(text, marker)")).select(F.col("path").alias("file"), "line", "marker")


def debt_first(lines: DataFrame) -> DataFrame:
    """(file, line, marker): the first marker in table order that is followed by colon, bracket or blank."""
    chain = None
    for m in tables.DEBT_TOOL:
        hit = F.col("text").rlike(f"{m}[:( ]")
        chain = F.when(hit, m) if chain is None else chain.when(hit, m)
    return lines.select(F.col("path").alias("file"), "line", chain.alias("marker")).filter(F.col("marker").isNotNull())


def in_string(text: Column, word: str) -> Column:
    """Whether word begins within double quotes; a quote after a backslash neither opens nor closes. What stands
    between quotes is every other piece of the text cut at them."""
    pieces = F.split(F.regexp_replace(text, r'\\"', r"\\'"), '"')
    inner = F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: s["i"] % 2 == 1)
    return F.exists(inner, lambda s: s["p"].contains(word))


def debt_items(lines: DataFrame) -> DataFrame:
    """(file, line, type, text): the first marker in table order outside strings that colon, bracket or blank
    follows, with the comment's text after it."""
    t, kind, rest = F.col("trimmed"), F, F
    for m in tables.DEBT_TOOL:
        hit = t.rlike(f"{m}[:( ]") & ~in_string(t, m)
        after = F.regexp_replace(F.substr("text", F.instr("text", F.lit(m)) + len(m)), r"^:*\(*", "")
        kind, rest = kind.when(hit, m.lower()), rest.when(hit, F.trim(F.regexp_replace(F.regexp_replace(F.trim(after), r"(\*/)+$", ""), r"\)+$", "")))
    return lines.select(F.col("path").alias("file"), "line", kind.alias("type"), rest.alias("text")).filter("type is not null")


def first_of(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    rules = [Rule(p, "", "", "", p, "") for p in patterns]
    return lines.withColumn("n", first_match(F.col("text"), rules)).filter(F.col("n").isNotNull()).select(F.col("path").alias("file"), "line", attribute(F.col("n"), rules, "id").alias("pattern"))


def is_test(path: Column) -> Column:
    return path.contains("test") | path.contains("spec")


def raw_logs(lines: DataFrame) -> DataFrame:
    """Outside tests and comments."""
    return first_of(lines.filter(~is_test(F.col("path")) & ~F.col("trimmed").rlike("^(//|#)")), RAW_LOGS)


def nondeterminism(lines: DataFrame) -> DataFrame:
    return first_of(lines.filter(is_test(F.col("path")) | F.col("path").endswith(".rs")), NONDETERMINISM)


def unguarded_unwraps(lines: DataFrame) -> DataFrame:
    """Rust unwrap and expect without SAFETY on the line before or a context on the line."""
    t = F.col("text")
    hit = (t.contains(".unwrap()") | t.contains(".expect(")) & ~F.col("before").contains("SAFETY") & ~t.contains(".context(")
    return knowing(in_extensions(lines, ("rs",)), "before").filter(hit).select(F.col("path").alias("file"), "line")


def structured_logging(files: DataFrame) -> DataFrame:
    """One row (files, structured): files (path, content) that aren't tests, and those that import a logging library."""
    hit = reduce(or_, [F.col("content").contains(p) for p in tables.LOG_IMPORTS])
    return files.filter(~is_test(F.col("path"))).agg(F.count(F.lit(1)).alias("files"), F.count(F.when(hit, 1)).alias("structured"))
