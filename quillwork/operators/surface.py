"""What functions declare: types, documentation, property tests, and parameters worth fuzzing.

Signatures are read by pattern from the line that begins them; lines with the state ``head`` show a parameter list that
goes on over several lines whole (whole_heads).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import extension

PYTHON, TYPED_SCRIPT, SCRIPT = ("py", "pyi"), ("ts", "tsx", "mts"), ("js", "mjs", "cjs")


def whole_heads(lines: DataFrame) -> DataFrame:
    """lines (with the state head), each head in place of the line that begins it."""
    return lines.withColumn("trimmed", F.col("head")).drop("head")


def _any(text: Column, *parts: str) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def _starts(text: Column, *parts: str) -> Column:
    return reduce(or_, [text.startswith(p) for p in parts])


def _between(text: Column, last: bool) -> Column:
    """What stands between the first bracket and the last (or next) that closes."""
    return F.regexp_extract(text, r"\((.*)\)" if last else r"\(([^)]*)\)", 1)


def _annotated(parameters: Column, *but: str) -> Column:
    parts = F.transform(F.split(parameters, ","), F.trim)
    return F.exists(parts, lambda p: (p != "") & ~p.isin(*but) & p.contains(":"))


def typed_functions(lines: DataFrame) -> DataFrame:
    """(file, line, language, typed) of lines with the state above: Python by annotations of a parameter or a
    return other than None, TypeScript by those of a parameter or return, JavaScript by a tag in a comment up
    to five lines above."""
    ext, t = extension(F.col("path")), F.col("trimmed")
    python = ext.isin(*PYTHON) & _starts(t, "def ", "async def ")
    named = _starts(t, "function ", "async function ")
    method = t.contains("): ") & _starts(t, "public ", "private ", "protected ") | t.contains("): ") & _any(t, "=> {", "=> (")
    typescript, javascript = ext.isin(*TYPED_SCRIPT) & (named | method), ext.isin(*SCRIPT) & named
    language = F.when(python, "Python").when(typescript, "TypeScript").when(javascript, "JavaScript")
    typed = (
        F.when(python, (t.contains("->") & ~t.endswith("-> None:")) | _annotated(_between(t, True), "self", "cls"))
        .when(typescript, _annotated(_between(t, False), "...") | (t.contains("): ") & ~t.endswith("): void {")) | t.contains("): void"))
        .when(javascript, F.exists("above", lambda a: _any(a, "@param", "@returns", "@type")))
    )
    return lines.select(F.col("path").alias("file"), "line", language.alias("language"), typed.alias("typed")).filter("language is not null")


def coverage(items: DataFrame, by: list[str], flag: str, least: float, empty: float = 100.0) -> DataFrame:
    """(..., total, covered, pct, below): pct is empty where there is nothing to cover (which only an ungrouped
    table can show)."""
    sums = items.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(flag), 1)).alias("covered"))
    pct = F.round(F.when(F.col("total") > 0, F.col("covered") * 100.0 / F.col("total")).otherwise(empty), 6)
    return sums.withColumn("pct", pct).withColumn("below", F.col("pct") < least)


# Prefixes of documentation by language, and heads of public items.
DOCUMENTATION = {"rs": ("///", "/**", "//!"), "py": ("#",), "js": ("*", "/**"), "ts": ("*", "/**"), "go": ("//", "/*", "///", "/**")}
PUBLIC = {
    "rs": r"^pub(?:\([^)]*\))? (?:async |unsafe |const )*(fn|struct|enum|trait) ",
    "py": r"^(?:async )?(def|class) ",
    "js": r"^(?:export )?(?:default )?(?:async )?(function|class) ",
    "ts": r"^(?:export )?(?:default )?(?:async )?(function|class) ",
    "go": r"^(func|type) ",
}


def documented_items(lines: DataFrame) -> DataFrame:
    """(file, line, kind, documented) of lines with the states above and after: a public item is documented by a
    comment of its language in the four lines above, whatever stands between, or by a Python docstring."""
    t, near = F.col("trimmed"), F.slice(F.col("above"), F.greatest(F.size("above") - 3, F.lit(1)), F.lit(4))
    ext = extension(F.col("path"))
    kind, documented = F, F

    def commented(prefixes: tuple[str, ...]) -> Column:
        return F.exists(near, lambda a: _starts(a, *prefixes))

    for e, prefixes in DOCUMENTATION.items():
        comment = commented(prefixes)
        if e == "py":
            comment = comment | F.col("after").rlike("^[rRbBuU]?[\"']")
        kind = kind.when(ext == e, F.regexp_extract(t, PUBLIC[e], 1))
        documented = documented.when(ext == e, comment)
    return lines.select(F.col("path").alias("file"), "line", kind.alias("kind"), documented.alias("documented")).filter("kind <> ''")


#: Public items of Rust as the check sees them: plain pub, in impl blocks too.
RUST_PUBLIC = r'^pub (?:(?:async|unsafe|const|extern(?: "[^"]*")?) )*(fn|struct|enum|trait) '


def attached_items(lines: DataFrame) -> DataFrame:
    """(file, line, kind, documented) as the documentation check counts them, of lines with the states above, after and
    attached: a public item of Rust is documented by what is attached to it, those of other languages as documented_items
    has it."""
    rust = lines.filter(extension(F.col("path")) == "rs").select(F.col("path").alias("file"), "line", F.regexp_extract("trimmed", RUST_PUBLIC, 1).alias("kind"), F.col("attached").alias("documented")).filter("kind <> ''")
    return rust.unionByName(documented_items(lines.filter(extension(F.col("path")) != "rs")))


def documentation_check(items: DataFrame, least: float = 80.0) -> DataFrame:
    """One row (total, covered, pct, passed, rule_id, severity): without items the coverage is full."""
    row = coverage(items, [], "documented", least)
    low = F.col("pct") < least * 0.5
    rule = F.when(~F.col("below"), "doccov-pass").when(low, "doccov-low").otherwise("doccov-moderate")
    severity = F.when(~F.col("below"), "info").when(low, "error").otherwise("warning")
    return row.select("total", "covered", "pct", (~F.col("below")).alias("passed"), rule.alias("rule_id"), severity.alias("severity"))


# Words that aren't names of functions under test.
NOT_NAMES = (
    "if", "else", "while", "for", "loop", "match", "fn", "let", "mut", "pub", "use", "mod", "struct", "enum", "impl", "trait", "const", "static", "type", "where",
    "return", "break", "continue", "move", "ref", "self", "super", "crate", "async", "await", "dyn", "as", "in", "true", "false", "none", "some", "ok", "err",
    "result", "option", "vec", "string", "str", "u8", "u16", "u32", "u64", "i32", "i64", "f32", "f64", "bool", "char", "box", "rc", "arc", "cell", "refcell",
    "mutex", "rwlock", "thread", "spawn", "join", "main",
)
SCRIPTS = ("js", "ts", "tsx", "mjs", "cjs", "mts")


def _name(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def property_coverage(lines: DataFrame) -> DataFrame:
    """(name, property_tested, unit_tested) of functions by name over all files (lines with the state after): a
    Rust property macro names what it tests, an inline one tests itself, Python by a given() above, scripts by
    the value that a property assertion stands in."""
    ext, t = extension(F.col("path")), F.col("trimmed")
    rust, python, script, go = ext == "rs", ext.isin(*PYTHON), ext.isin(*SCRIPTS), ext == "go"
    rust_fn = _name(t, r"^.*?fn ([^(\s]+)[(\s]")
    python_fn, go_fn = _name(t, r"^def ([^(\s]+)"), _name(t, r"^func ([^(\s]+)")
    script_fn = F.when(t.startswith("function "), _name(t, r"^function ([^(\s]+)")).when(t.contains("const ") & t.contains("=>"), _name(t, r"const ([^=\s]+)")).otherwise("")
    function = (
        F.when(rust & _starts(t, "fn ", "pub fn "), F.when(F.lower(rust_fn).isin(*NOT_NAMES), "").otherwise(rust_fn))
        .when(python & t.startswith("def "), python_fn).when(script, script_fn).when(go & t.startswith("func "), go_fn).otherwise("")
    )
    words = F.filter(F.regexp_extract_all(F.col("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: (F.octet_length(w) > 3) & ~F.lower(w).isin(*NOT_NAMES))
    macro = rust & _any(t, "proptest!", "quickcheck!", "#[quickcheck]", "# [ quickcheck ]")
    inline = rust & t.startswith("fn ") & t.contains("prop")
    given = python & _any(t, "@given", "@hypothesis.given")
    asserted = script & _any(t, "fc.assert", "fastCheck", "property(")
    in_value = F.when(t.contains("function "), _name(t, r"function ([^(\s]+)")).when(t.contains("const ") & t.contains("="), _name(t, r"const ([^=\s]+)")).otherwise("")
    tested = F.concat(
        F.when(macro, words).otherwise(F.array().cast("array<string>")),
        F.array(F.when(inline, rust_fn).otherwise("")), F.array(F.when(given, _name(F.col("after"), r"^def ([^(\s]+)")).otherwise("")), F.array(F.when(asserted & ~script_fn.eqNullSafe(""), in_value).otherwise("")),
    )
    unit = (rust & (t.startswith("#[test]") | t.contains("# [ test ]"))) | (python & _starts(t, "def test_", "async def test_")) | (go & t.startswith("func Test"))
    seen = lines.select("path", ext.alias("ext"), function.alias("function"), F.filter(tested, lambda n: n != "").alias("tested"), unit.alias("unit"))
    has_unit = F.max(F.col("unit")).alias("any_unit")
    files = seen.groupBy("path", "ext").agg(
        has_unit, F.collect_set(F.when(F.col("function") != "", F.struct("function", "unit"))).alias("functions"), F.array_distinct(F.flatten(F.collect_list("tested"))).alias("tested")
    )
    each = files.select("ext", "any_unit", "tested", F.explode("functions").alias("f"))
    # in Rust one test speaks for a file's functions, elsewhere a test function for itself
    own = F.when(F.col("ext") == "rs", F.col("any_unit")).otherwise(F.col("f.unit"))
    return each.groupBy(F.col("f.function").alias("name")).agg(F.bool_or(F.array_contains("tested", F.col("f.function"))).alias("property_tested"), F.bool_or(own).alias("unit_tested"))


# What parameters of a language are worth, the first that one holds.
FUZZED = {
    "rs": ((30, ("&[u8]", "bytes")), (20, ("string", "&str")), (25, ("vec<u8>",)), (10, ("path", "reader", "stream"))),
    "py": ((30, ("bytes", "bytearray")), (20, ("str",)), (15, ("list",))),
    "js": ((30, ("uint8array", "buffer")), (20, ("string",)), (15, ("array", "[]"))),
    "go": ((30, ("[]byte",)), (20, ("string",)), (10, ("interface",))),
}
HEADS = {
    "rs": r"^(?:pub )?(?:async )?fn ([^(\s]+).*\(",
    "py": r"^(?:async )?def ([^(]+?)\s*\(",
    "js": r"^function ([^(]+?)\s*\(",
    "go": r"^func ([^(]+?)\s*\(",
}
#: Languages whose signatures aren't parsed: a function counts flat.
FLAT = {"java": r"^(?:(?:public|private|protected|static|final|void|int|String|boolean|long|double) )+(?:\w+ )?(\w+)\(", "cs": r"^(?:(?:public|private|protected|static|void|int|string|bool) )+(?:\w+ )?(\w+)\(", "php": r"^function (\w+)", "rb": r"^def (\w+)", "swift": r"^func (\w+)", "kt": r"^fun (\w+)", "sol": r"^function (\w+)"}
FLAT_SCORE = 10


def harness_names(lines: DataFrame) -> DataFrame:
    """(name) of what fuzz targets below a folder fuzz name."""
    named = lines.filter(F.col("path").rlike(r"(^|/)fuzz/[^/]*\.rs$") & F.col("text").contains("fuzz_target!"))
    words = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("name")
    return named.select(words).filter(~F.col("name").isin("fuzz_target", "libfuzzer")).distinct()


def fuzz_surface(lines: DataFrame, harnesses: DataFrame, complexities: DataFrame) -> DataFrame:
    """(file, line, name, score, public, complexity, harnessed): functions by what their parameters are worth, 10
    more if public (Rust), 2 a parameter, 5 less with a harness (Rust); those worth nothing are left out.
    complexity: the first of that name in the file (complexities: file, name, line, complexity), else 10."""
    ext, t = extension(F.col("path")), F.col("trimmed")
    kind = F.when(ext.isin("ts", "tsx", "mjs"), "js").otherwise(ext)
    name, worth, flat = F, F, F
    for e, head in HEADS.items():
        name = name.when(kind == e, F.regexp_extract(t, head, 1))
    for e, head in FLAT.items():
        flat = flat.when(kind == e, F.regexp_extract(t, head, 1))
    listed = F.when(_between(t, True) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(_between(t, True), ","), F.trim))

    def value(p: Column, grades: tuple) -> Column:
        chain = F
        for points, words in grades:
            chain = chain.when(_any(F.lower(p), *words), points)
        return chain.otherwise(0)

    def total(grades: tuple) -> Column:
        return F.aggregate(F.transform(listed, lambda p: value(p, grades)), F.lit(0), lambda a, b: a + b)

    for e, grades in FUZZED.items():
        worth = worth.when(kind == e, total(grades))
    seen = lines.filter(~_starts(t, "//", "#", "/*", "[", "@", "*")).select(F.col("path").alias("file"), "line", kind.alias("kind"), F.coalesce(name, F.lit("")).alias("parsed"), F.coalesce(flat, F.lit("")).alias("flat"), F.coalesce(worth, F.lit(0)).alias("worth"), F.size(listed).alias("n"), t.alias("t"))
    seen = seen.filter(((F.col("parsed") != "") & (F.col("worth") > 0)) | (F.col("flat") != ""))
    seen = seen.withColumn("name", F.when(F.col("parsed") != "", F.col("parsed")).otherwise(F.col("flat")))
    public = (
        F.when(F.col("kind") == "rs", F.col("t").startswith("pub ")).when(F.col("kind") == "py", ~F.col("name").startswith("_")).when(F.col("kind") == "go", F.col("name").rlike(r"^\p{Lu}"))
        .when(F.col("kind").isin("java", "cs", "kt", "sol"), ~F.col("t").startswith("private ")).when(F.col("kind") == "swift", _starts(F.col("t"), "public ", "open ")).otherwise(True)
    )
    first = complexities.groupBy("file", "name").agg(F.min_by("complexity", "line").alias("complexity"))
    known = seen.withColumn("public", public).join(first, ["file", "name"], "left").join(harnesses.withColumn("harnessed", F.lit(True)), "name", "left")
    harnessed = F.coalesce("harnessed", F.lit(False)) & (F.col("kind") == "rs")
    score = F.col("worth") + F.when((F.col("kind") == "rs") & F.col("public"), 10).otherwise(0) + 2 * F.col("n") - F.when(harnessed, 5).otherwise(0)
    score = F.when(F.col("flat") != "", FLAT_SCORE).otherwise(score)
    complexity = F.when(F.col("flat") != "", 1).otherwise(F.coalesce("complexity", F.lit(10)))
    return known.select("file", "line", "name", score.alias("score"), "public", complexity.alias("complexity"), harnessed.alias("harnessed"))
