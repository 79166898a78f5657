"""Checks that look at several lines of a file: taint, dead code, documentation, and mutants.

States of lines are found within a file's array of lines; only hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import line_state
from ..sources.corpus import extension

# Words that make a variable sensitive; sinks by language and in order of precedence.
SENSITIVE = ("password", "secret", "token", "api_key", "apikey", "private_key", "credential", "auth_key", "access_key")
SINKS = {
    "rust": (
        ("LOG_LEAK", ("log::info!", "log::warn!", "log::error!", "log::debug!", "log::trace!")),
        ("PRINT_LEAK", ("println!", "print!", "eprintln!", "eprint!")),
        ("FILE_WRITE", ("std::fs::write", "File::create", "fs::File::create", "std::fs::OpenOptions")),
        ("UNFILTERED_RETURN", ()),
        ("DEBUG_LEAK", ("dbg!", "debug!", "trace!")),
    ),
    "python": (("LOG_LEAK", ("logging.", "logger.", "log.")), ("PRINT_LEAK", ("print(",)), ("DEBUG_LEAK", ("pprint", "repr("))),
    "script": (
        ("LOG_LEAK", ("console.log", "console.warn", "console.error", "logger.", "log.info", "winston.", "bunyan.")),
        ("PRINT_LEAK", ("process.stdout", "process.stderr")),
        ("DEBUG_LEAK", ("console.debug", "console.trace")),
    ),
    "go": (
        ("LOG_LEAK", ("log.Print", "log.Fatal", "log.Panic", "fmt.Fprintf", "logrus.", "zap.")),
        ("PRINT_LEAK", ("fmt.Print", "fmt.Sprintf")),
        ("DEBUG_LEAK", ("fmt.Printf", "log.Printf")),
    ),
}
TAINT_SEVERITY = {"LOG_LEAK": "high", "PRINT_LEAK": "high", "FILE_WRITE": "medium", "UNFILTERED_RETURN": "medium", "DEBUG_LEAK": "low"}
#: Extensions of the languages that taint knows, and the variable that a line assigns to.
TAINT_EXTENSIONS = {"rust": ("rs",), "python": ("py", "pyi"), "script": ("js", "mjs", "cjs", "ts", "tsx", "mts"), "go": ("go",)}
WORD = r"[\p{L}\p{N}_]"
ASSIGNED = {
    "rust": (rf"^(?:let|const|static)\s+(?:mut )?({WORD}+)(?:[^\p{{L}}\p{{N}}_])",),
    "python": (rf"^({WORD}+)\s*=",),
    "script": ("^(?:const|let|var) ([^=:; ]+)",),
    "go": (r"^var \s*(\S+)", r"^([^,]*[^,\s])\s*:="),
}

# Textual swaps of the mutation strategies; what a boundary swap must not meet as well.
SWAPS = {
    "standard": (
        ("+", "-"), ("-", "+"), ("*", "/"), ("/", "*"), ("==", "!="), ("!=", "=="), (">", "<"), ("<", ">"), (">=", "<="), ("<=", ">="), ("&&", "||"), ("||", "&&"),
        ("true", "false"), ("false", "true"),
    ),
    "boundary": ((" < ", " <= "), (" <= ", " < "), (" >= ", " > "), (" > ", " >= ")),
    "bitwise": ((" ^ ", " | "), (" | ", " ^ "), (" << ", " >> "), (" >> ", " << "), (" & ", " | "), (" | ", " & ")),
}
UNLESS = {("standard", "true"): "// true", ("standard", "false"): "// false", ("boundary", " < "): " <= ", ("boundary", " > "): " >= "}
CALLS = tuple(f"{kind}_{op}" for kind in ("wrapping", "saturating", "checked") for op in ("add", "sub", "mul"))


def any_of(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def sink(trimmed: Column, language: str = "rust") -> Column:
    chain = F
    for kind, words in SINKS[language]:
        chain = chain.when(any_of(trimmed, words) if words else trimmed.startswith("pub fn"), kind)
    return chain


def by_language(ext: Column, make: Callable[[str], Column]) -> Column:
    chain = F
    for language, extensions in TAINT_EXTENSIONS.items():
        chain = chain.when(ext.isin(*extensions), make(language))
    return chain


def assigned(trimmed: Column, language: str) -> Column:
    """The variable that the line assigns to, "" if none."""
    first, *more = (F.regexp_extract(trimmed, p, 1) for p in ASSIGNED[language])
    for m in more:
        first = F.when(first == "", m).otherwise(first)
    return first


def taint(files: DataFrame) -> DataFrame:
    """(file, line, variable, kind, severity): lines that name a variable made sensitive before, and are a sink.

    A variable is sensitive by its name, by a marker on the last line before its own that isn't blank, or by
    a ``Secret::`` value. Lines that make one sensitive, marker lines and test functions (Rust) are no sinks.
    """
    known = files.filter(extension(F.col("path")).isin(*(e for es in TAINT_EXTENSIONS.values() for e in es)))
    # a file that holds none of these words makes no variable sensitive
    known = known.filter(F.col("content").rlike("(?i)sensitive|Secret::|" + "|".join(SENSITIVE)))
    ext, rust = F.col("ext"), F.col("ext") == "rs"

    t = F.col("trimmed")
    each = line_state.lines(known.select("path", "content"), "in_test", "marked", "ext")
    skipped = F.col("in_test") | line_state.begins_test(t, rust) | line_state.is_marker(t, rust)
    name = F.when(~skipped, by_language(ext, lambda lang: assigned(t, lang)))
    kind = F.when(~skipped, by_language(ext, lambda lang: sink(t, lang)))
    # what makes a variable sensitive and what may leak one is all that is shuffled
    found = F.struct(F.coalesce(name, F.lit("")).alias("name"), kind.alias("kind"))
    # by a generator, so that filters don't work names out again for each word that they look for
    judged = each.select("path", "line", "text", "trimmed", "marked", F.explode(F.array(found)).alias("f")).select("path", "line", "text", "trimmed", "marked", "f.*")
    made = (F.col("name") != "") & (any_of(F.lower("name"), SENSITIVE) | F.col("marked") | t.contains("Secret::"))
    judged = judged.withColumn("made", made).filter("made or kind is not null")
    sources = judged.filter("made").groupBy("path", F.col("name").alias("variable")).agg(F.min("line").alias("since"))
    uses = judged.filter("not made").select("path", "line", "text", "kind")
    leaks = uses.join(sources, "path").filter((F.col("line") > F.col("since")) & F.col("text").contains(F.col("variable")))
    severity = F.create_map(*[F.lit(x) for kv in TAINT_SEVERITY.items() for x in kv])
    return leaks.select(F.col("path").alias("file"), "line", "variable", "kind", severity[F.col("kind")].alias("severity"))


def python_import(trimmed: Column) -> Column:
    """The first name that a Python import brings in, "" if none."""
    taken = F.regexp_extract(trimmed, r"^(?:from .*? import|import)\s+([^\s,]+)", 1)
    return F.regexp_replace(taken, rf"^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$", "")


def script_imports(trimmed: Column) -> Column:
    """The names that a JavaScript or TypeScript import brings in."""
    inner = F.regexp_extract(trimmed, r"\{([^}]*)\}", 1)
    named = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), " as .*$", ""))), lambda n: n.rlike(r"^\p{L}"))
    default = F.regexp_replace(F.regexp_extract(trimmed, r"^import\s+(\S+)", 1), r"^\*+|\*+$", "")
    return F.when(trimmed.contains("{"), named).otherwise(F.filter(F.array(default), lambda n: (n != "") & (n != "type")))


def dead_code(files: DataFrame) -> DataFrame:
    """(file, line, kind, severity): allowed dead code, imports of a name that occurs once in its file, branches
    on a constant, discarded values, and empty blocks."""
    ext, script = F.col("ext"), ("js", "ts", "mjs", "tsx")

    def kinds(x: Column) -> Column:
        t, previous = x["trimmed"], x["previous"]
        mark = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit("").alias("name"))
        opens = any_of(previous, ("fn ", "def ", "function ")) | previous.endswith("else") | previous.endswith("else {")
        found = F.array_compact(F.array(
            F.when(t.contains("#[allow(dead_code)]") | t.contains("# noqa: F401"), mark("allow_dead_code", "medium")),
            F.when(t.isin("if false {", "if (false) {"), mark("unreachable_branch", "high")),
            F.when(t.isin("if true {", "if (true) {"), mark("unreachable_branch", "medium")),
            F.when((ext == "rs") & (t.startswith("let _ =") | t.startswith("let _x =")), mark("dead_assignment", "low")),
            F.when(t.isin("{}", "{ }") & opens, mark("empty_block", "low")),
        ))
        names = F.when((ext == "py") & (t.startswith("import ") | t.startswith("from ")), F.filter(F.array(python_import(t)), lambda n: n != ""))
        names = names.when(ext.isin(*script) & t.startswith("import ") & t.contains("from "), script_imports(t)).otherwise(F.array().cast("array<string>"))
        return F.concat(found, F.transform(names, lambda n: F.struct(F.lit("unused_import").alias("kind"), F.lit("low").alias("severity"), n.alias("name"))))

    each = line_state.arrays(files, "previous").select("path", "ext", F.explode(F.array(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))).alias("whole"), "lines")
    found = each.select("path", "whole", F.explode(F.flatten(F.transform("lines", lambda x, i: F.transform(kinds(x), lambda k: F.struct((i + 1).alias("line"), k.alias("k")))))).alias("f"))
    times = (F.length("whole") - F.length(F.replace("whole", F.col("f.k.name"), F.lit("")))) / F.length("f.k.name")
    return found.filter((F.col("f.k.name") == "") | (times <= 1)).select(F.col("path").alias("file"), "f.line", "f.k.kind", "f.k.severity")


def mutants(lines: DataFrame, *strategies: str) -> DataFrame:
    """(file, line, category, original, mutated): every swap of the strategies (all if none is named) that applies
    to a line that is no comment; mutated is the new line."""
    kinds = strategies or (*SWAPS, "arithmetic")
    text, rows = F.col("text"), []
    put = lambda hit, kind, old, new: F.when(hit, F.struct(F.lit(kind).alias("category"), F.lit(old).alias("original"), new.alias("mutated")))
    for kind in kinds:
        for old, new in SWAPS.get(kind, ()):
            hit = text.contains(old)
            if (kind, old) in UNLESS:
                hit = hit & ~text.contains(UNLESS[kind, old])
            swapped = F.replace(text, F.lit(old), F.lit(new)) if kind != "boundary" else _first_replaced(text, old, new)
            rows.append(put(hit, kind, old, swapped))
        if kind == "arithmetic":
            rows += [put(text.contains(c), kind, c, F.replace(F.replace(text, F.lit(f".{c}("), F.lit(".")), F.lit(f"{c}("), F.lit("( "))) for c in CALLS]
    each = lines.filter(~F.col("trimmed").startswith("//")).select(F.col("path").alias("file"), "line", F.explode(F.array_compact(F.array(*rows))).alias("m"))
    return each.select("file", "line", "m.*")


def _first_replaced(text: Column, old: str, new: str) -> Column:
    at = F.instr(text, F.lit(old))
    return F.concat(F.left(text, at - 1), F.lit(new), F.substr(text, at + len(old)))


def limited(found: DataFrame, most: int, file_order: str = "file") -> DataFrame:
    """At most so many mutants, over all files in order: a rank within a file after the running total of the files
    before it. The first files that hold one each suffice, so that the running total is over as many rows."""
    counts = found.groupBy(file_order).agg(F.count(F.lit(1)).alias("n")).orderBy(file_order).limit(most)
    spread = F.sum("n").over(Window.orderBy(file_order).rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("before", F.coalesce(spread, F.lit(0))).filter(F.col("before") < most)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(file_order).orderBy("category", "original", "line")))
    return ranked.join(before.select(file_order, "before"), file_order).filter(F.col("before") + F.col("rank") <= most).drop("before", "rank")


def mutation_score(results: DataFrame) -> DataFrame:
    """(file, killed, total, score) of mutants with a status; none: 100."""
    n = results.groupBy("file").agg(F.count(F.when(F.col("status") == "killed", 1)).alias("killed"), F.count(F.lit(1)).alias("total"))
    return n.withColumn("score", F.round(F.col("killed") * 100.0 / F.col("total"), 6))


def glob_pattern(glob: str) -> str:
    """The regex of a glob: ** crosses folders, * stays in one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|?\\" else glob[i]), i + 1
    return "^" + out


def override(files: DataFrame, globs: dict[str, str]) -> DataFrame:
    """files with the value of the longest glob that the path matches, null if none: one CASE."""
    chain = F
    for g in sorted(globs, key=lambda g: (-len(g), g)):
        chain = chain.when(F.col("path").rlike(glob_pattern(g)), globs[g])
    return files.withColumn("override", chain if globs else F.lit(None).cast("string"))
