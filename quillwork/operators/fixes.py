"""Proposed fixes of Rust files as patches, their diffs, and files with patches applied. No file is written.

A patch replaces the lines from ``line`` on that ``old_text`` spans by ``new_text``, which may have more lines (an
inserted attribute is a line and what it stands above). Rules are tried in the order of RULES, and several may
propose for one line; a file takes patches from its last line up, in that order, and a patch is rejected if its lines
don't read as old_text any more. A file whose brackets would no longer balance keeps its text, and all of its patches
are rejected.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.line_state import once, trim
from . import ranges

RULES = ("errhandle", "deadcode", "debt", "secrets", "crypto", "doccov")
# Debt markers, names and prefixes of secrets, words beside which a random number is sensitive, and heads
# of public items, each in the order they are tried in.
MARKERS = ("TODO:", "FIXME:", "HACK:", "XXX:", "todo:", "fixme:", "hack:", "xxx:")
SECRET_NAMES = ("api_key", "apikey", "API_KEY", "secret", "SECRET", "password", "PASSWORD", "token", "TOKEN", "auth_token", "AUTH_TOKEN", "access_key", "ACCESS_KEY", "private_key", "PRIVATE_KEY")
SECRET_PREFIXES = ("sk-", "sk_live_", "sk_test_", "ghp_", "gho_", "ghu_", "ghs_", "AKIA", "xoxb-", "xoxp-", "xoxa-", "eyJ", 'key="', 'key = "')
SENSITIVE = ("key", "secret", "token", "nonce", "salt", "iv", "Key", "Secret", "Token", "Nonce", "Salt", "IV", "password", "Password")
PUBLIC = ("pub fn ", "pub struct ", "pub enum ", "pub trait ")
_NAME = r"[\p{L}\p{N}_]"


def in_code(text: Column, at: Column) -> Column:
    """Whether a place is outside line comments and double quotes."""
    before = F.left(text, at - 1)
    quotes = F.length(before) - F.length(F.replace(before, F.lit('"'), F.lit("")))
    return ~F.ltrim(before).startswith("//") & (quotes % 2 == 0)


def _starts(text: Column, *parts: str) -> Column:
    return reduce(or_, [text.startswith(p) for p in parts])


def _patch(rule: str, confidence: str, new: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(confidence).alias("confidence"), new.alias("new_text"))


def _indent(text: Column) -> Column:
    return F.regexp_extract(text, r"^[ \t\r\n\f]*", 0)


def inside_brackets(after: Column) -> Column:
    """What stands before the bracket that closes one opened just before the text, brackets in strings aside; null if none does."""
    pieces = F.regexp_extract_all(after, F.lit(r'"(?:\\.|[^"\\])*"?|[()]|[^()"]+'), 0)
    zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))

    def step(a: Column, piece: Column) -> Column:
        depth = F.when(a["depth"] == 0, 0).otherwise(a["depth"] + F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0))
        return F.struct(depth.alias("depth"), (a["size"] + F.when(depth == 0, 0).otherwise(F.length(piece))).alias("size"))

    found = F.aggregate(pieces, zero, step)
    return once(found, lambda f: F.when(f["depth"] == 0, F.left(after, f["size"])))


def _error_handling(text: Column, t: Column) -> Column:
    """An unwrap becomes a question mark; an expectation becomes an error with its message, and a question mark."""
    unwrap = F.instr(text, F.lit(".unwrap()"))
    first = _patch("errhandle-unwrap", "medium", F.concat(_indent(text), trim(F.left(text, unwrap - 1)), F.lit("?"), F.substr(text, unwrap + 9)))
    expect = F.instr(text, F.lit(".expect("))
    message = inside_brackets(F.substr(text, expect + 8))

    def second(m: Column) -> Column:
        said = F.when(m.contains('"'), F.concat(F.lit('format!("'), F.regexp_replace(m, r'^"+|"+$', ""), F.lit(': {e}")'))).otherwise(F.concat(F.lit('{ "'), m, F.lit(': {e}".to_string() }')))
        new = F.concat(_indent(text), trim(F.left(text, expect - 1)), F.lit(".map_err(|e| "), said, F.lit(")?"), F.substr(text, expect + 9 + F.length(m)))
        return F.when(m.isNotNull(), _patch("errhandle-expect", "medium", new))

    taken = (unwrap > 0) & in_code(text, unwrap)
    return F.when(t.startswith("#"), None).when(taken, first).when((expect > 0) & in_code(text, expect), once(message, second))


def _dead_code(text: Column, t: Column, above: Column) -> Column:
    """A private function without attributes gets one that allows it to be unused."""
    private = _starts(t, "fn ", "async fn ") & ~(above.contains("#[allow(dead_code)]") | above.startswith("#["))
    return F.when(private, _patch("deadcode-annotate", "high", F.concat(_indent(text), F.lit("#[allow(dead_code)]\n"), text)))


def _debt(text: Column, t: Column) -> Column:
    """A marker gets an issue number to be filled in, unless one follows already."""

    def tracked(marker: str) -> Column:
        at = F.instr(text, F.lit(marker))
        after = trim(F.substr(text, at + len(marker)))
        new = F.concat(F.left(text, at - 1), F.lit(f"{marker.upper()}(#0): "), after)
        return F.when((at > 0) & (in_code(text, at) | t.startswith("//")) & ~_starts(after, "#", "(", "["), new)

    return once(F.coalesce(*map(tracked, MARKERS)), lambda new: F.when(new != text, _patch("debt-track", "high", new)))


def _secrets(text: Column, t: Column) -> Column:
    """A secret that is bound to a name, or looks like one by its first characters, comes from the environment."""
    names = "|".join(SECRET_NAMES)
    bound = rf'((?:const|static) ({names}): &str = |let (?:mut )?({names}) = )[ \t]*"([^"]*)"'
    value, constant, variable = (F.regexp_extract(text, bound, n) for n in (4, 2, 3))
    real = (F.octet_length(value) >= 4) & ~value.rlike(r"TODO|your|xxx|^http|^/|\{\}")
    # AUTH_TOKEN and the like are their own names, all others the name of what they hold
    env = F.replace(F.upper(F.coalesce(F.nullif(constant, F.lit("")), variable)), F.lit("APIKEY"), F.lit("API_KEY"))
    head = F.regexp_extract(text, rf"((?:const|static) (?:{names}): |let (?:mut )?(?:{names}) = )", 1)
    by_name = F.when(constant != "", F.concat(_indent(text), head, F.lit('String = std::env::var("'), env, F.lit('").expect("'), env, F.lit(' must be set");')))
    by_name = by_name.otherwise(F.concat(_indent(text), head, F.lit('std::env::var("'), env, F.lit('")?;')))
    seen = reduce(or_, [(F.instr(text, F.lit(p)) > 0) & in_code(text, F.instr(text, F.lit(p))) for p in SECRET_PREFIXES]) & ~text.rlike(r"env::|dotenv!|var\(")
    name = F.regexp_extract(t, rf"^(?:let mut |let |const |static )({_NAME}*)", 1)
    literal = F.concat(_indent(text), F.lit("let "), name, F.lit(' = std::env::var("'), F.when(name == "", "SECRET").otherwise(F.upper(name)), F.lit('")?;'))
    return F.when(_starts(t, "//", "use ", "#"), None).when(real, _patch("secrets-env", "low", by_name)).when(seen, _patch("secrets-literal", "low", literal))


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _crypto(text: Column, t: Column) -> list[Column]:
    """Weak digests and random numbers give way to sound ones; what a line imports is a patch of its own."""
    chain, live = F, ~t.startswith("//")
    for rule, confidence, holds, pairs in (
        ("crypto-weak-hash", "medium", F.lit(True), (("md5::compute(", "sha2::Sha256::digest("), ("md5::Md5", "sha2::Sha256"))),
        ("crypto-weak-hash", "medium", F.lit(True), (("sha1::Sha1", "sha2::Sha256"), ("sha1::digest(", "sha2::Sha256::digest("))),
        ("crypto-weak-rng", "medium", F.lit(True), (("rand::thread_rng()", "rand::rngs::OsRng"),)),
        ("crypto-weak-rng", "low", text.rlike("|".join(SENSITIVE)), (("rand::random()", "rand::rngs::OsRng.gen()"),)),
    ):
        new = _replaced(text, *pairs)
        chain = chain.when(live & holds & (new != text), _patch(rule, confidence, new))
    imports = F.when(t.isin("use md5;", "use sha1;", "use sha1::Sha1;"), _patch("crypto-weak-hash", "high", F.lit("use sha2::{Sha256, Digest};")))
    imports = imports.when(text.contains("use rand;"), _patch("crypto-weak-rng", "high", F.lit("use rand::rngs::OsRng;\nuse rand::RngCore;")))
    return [chain, imports]


def _documentation(text: Column, t: Column, above: Column) -> Column:
    """A public item without documentation gets a line to be filled in."""
    name = F.regexp_replace(F.coalesce(F.get(F.split(t, r"[ \t]+"), F.lit(2)), F.lit("item")), rf"(?:(?!{_NAME}).)+$", "")
    stub = F.concat(_indent(text), F.lit("/// TODO: document `"), name, F.lit("`\n"), text)
    return F.when(_starts(t, *PUBLIC) & ~above.startswith("///"), _patch("doccov-stub", "high", stub))


def proposals(lines: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(file, line, ord, rule_id, confidence, old_text, new_text) of Rust lines (path, line, text, trimmed, before): ord
    tells the rules of a line apart, in the order they are tried in."""
    text, t, above = F.col("text"), F.col("trimmed"), trim(F.col("before"))
    made = {
        "errhandle": [_error_handling(text, t)], "deadcode": [_dead_code(text, t, above)], "debt": [_debt(text, t)],
        "secrets": [_secrets(text, t)], "crypto": _crypto(text, t), "doccov": [_documentation(text, t, above)],
    }
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("ord"), p.alias("p")) for n, p in enumerate(c for r in RULES if r in rules for c in made[r])]), lambda x: x["p"].isNotNull())
    each = lines.filter(F.col("path").endswith(".rs")).select(F.col("path").alias("file"), "line", "text", F.explode(found).alias("f"))
    return each.select("file", "line", "f.ord", "f.p.rule_id", "f.p.confidence", F.col("text").alias("old_text"), "f.p.new_text")


def _signed(text: Column, sign: str) -> Column:
    return F.concat(F.lit(sign), F.replace(text, F.lit("\n"), F.lit(f"\n{sign}")), F.lit("\n"))


def _span(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def diffs(patches: DataFrame) -> DataFrame:
    """(file, line, rule_id, diff) of patches, as fragments of a unified diff; no text gives no line."""
    n = F.col("line").cast("string")

    def place(text: Column) -> Column:
        return F.concat(n, F.when(_span(text) > 1, F.concat(F.lit(","), _span(text).cast("string"))).otherwise(""))

    added = F.when(F.col("new_text") == "", "").otherwise(_signed(F.col("new_text"), "+"))
    body = F.concat(F.lit("--- "), "file", F.lit("\n+++ "), "file", F.lit("\n@@ -"), place(F.col("old_text")), F.lit(" +"), place(F.col("new_text")), F.lit(" @@\n"), _signed(F.col("old_text"), "-"), added)
    return patches.select("file", "line", "rule_id", body.alias("diff"))


def _net(text: Column, opens: str, closes: str) -> Column:
    return F.length(F.replace(text, F.lit(closes), F.lit(""))) - F.length(F.replace(text, F.lit(opens), F.lit("")))


def scheduled(files: DataFrame, patches: DataFrame) -> DataFrame:
    """(path, content, ls, patches, kept, result) of all files, whose lines are ls where there are patches (file, line,
    ord, old_text, new_text): kept are those that are applied, from the first line on, result the text they give."""
    each = patches.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct((-F.col("line")).alias("up"), "ord", "line", _span(F.col("old_text")).alias("span"), "old_text", "new_text")).alias("patches"))
    pieces = F.split(F.coalesce("content", F.lit("")), "\r?\n")
    joined = ranges.dealt(files.select("path", "content")).join(each, "path", "left").select("path", "content", "patches", F.explode(F.array(F.when(F.col("patches").isNotNull(), pieces))).alias("ls"))
    joined = joined.withColumn("ls", F.when(F.element_at("ls", -1) == "", F.slice("ls", 1, F.size("ls") - 1)).otherwise(F.col("ls")))
    fits = F.filter(F.array_sort("patches"), lambda p: (p["line"] >= 1) & (F.array_join(F.slice("ls", F.greatest(p["line"], F.lit(1)), p["span"]), "\n") == p["old_text"]))

    def take(a: Column, p: Column) -> Column:
        free = p["line"] + p["span"] <= a["least"]
        return F.struct(F.when(free, p["line"]).otherwise(a["least"]).alias("least"), F.when(free, F.concat(a["kept"], F.array(p))).otherwise(a["kept"]).alias("kept"))

    none = F.slice("patches", 1, 0)
    greedy = F.aggregate(fits, F.struct(F.lit(2**31 - 1).alias("least"), none.alias("kept")), take, lambda a: F.reverse(a["kept"]))
    kept = joined.withColumn("kept", F.when(F.col("patches").isNotNull(), greedy))
    # between two patches the lines stay; a patch gives its text, which may be none
    ends = F.concat(F.array(F.lit(0)), F.transform("kept", lambda k: k["line"] + k["span"] - 1))

    def stretch(k: Column, i: Column) -> Column:
        done = F.get(ends, i)
        return F.concat(F.slice("ls", done + 1, k["line"] - done - 1), F.when(k["new_text"] == "", F.slice("ls", 1, 0)).otherwise(F.array(k["new_text"])))

    last = F.element_at(ends, -1)
    result = F.concat(F.flatten(F.transform("kept", stretch)), F.slice("ls", last + 1, F.size("ls") - last))
    return kept.withColumn("result", F.array_join(result, "\n"))


def applied(files: DataFrame, patches: DataFrame) -> DataFrame:
    """(path, content, n_applied, n_rejected) of all files (path, content). The content of a file that changes ends without a line break."""

    def code(name: str) -> Column:
        return F.regexp_replace(F.array_join(F.transform("kept", lambda k: k[name]), "\n"), r'"(?:\\.|[^"\\\n])*"|//[^\n]*', "")

    sound = reduce(lambda a, b: a & b, [_net(code("new_text"), *p) == _net(code("old_text"), *p) for p in ("()", "[]", "{}")])
    changed = F.when(sound, F.size("kept")).otherwise(0)
    done = scheduled(files, patches).select("path", "content", "result", changed.alias("n_applied"), F.when(F.col("patches").isNotNull(), F.size("patches")).otherwise(0).alias("n"))
    return done.select("path", F.when(F.col("n_applied") > 0, F.col("result")).otherwise(F.col("content")).alias("content"), "n_applied", (F.col("n") - F.col("n_applied")).alias("n_rejected"))
