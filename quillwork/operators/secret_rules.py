"""Secrets in source lines: keyword assignments and literals of high entropy, and what rules them out."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .rule_tables import SECRETS
from .scans import attribute, first_match

# What marks examples, descriptions, bare keywords, prose, markup and code.
EXAMPLES = ("example", "placeholder", "your_", "<your", "changeme", "test_")
DESCRIPTIONS = ("description:", "detects ", "flagging", "pattern:", "replaces ", "move `", "hardcoded ", "never use", "restrict ", "enforce ", "remediation:", "sudoers", "nopasswd")
KEYWORDS = ("password", "secret", "key", "token", "api_key", "api_secret", "auth_token", "access_token", "private_key")
PROSE = ("Hardcoded", "Replace", "Move ", "Never ", "Restrict", "Detects", "Default", "Literal", "Sudoers")
MARKUP = ("<span", "<div", "<p>", "<tr", "<td", "<table", "<link", "font-weight", "font-size", "font-family", "padding:", "line-height", "text-align", "style=", "border-")
CODE = ("\\n+", "\\n-", "+ let ", "- let ", "+ if ", "- if ", "api_key = std", "env::var")
FORMATS = ("{}", "{:?}", "{ }")
COMMON_WORDS, PUNCTUATION = ("the ", " and ", " is ", " for ", " to "), (".", ",", ";")
#: Literals of either quote: escapes are pairs, and one that isn't closed goes on to the end of the line.
LITERAL = r"""\"([^\"\\]*(?:\\.?[^\"\\]*)*)\"?|'([^'\\]*(?:\\.?[^'\\]*)*)'?"""
LEAST_BYTES, HIGH = 12, 5.5


def any_of(text: Column, words) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def is_example(text: Column, trimmed: Column) -> Column:
    return any_of(F.lower(text), EXAMPLES) | trimmed.rlike(r"^(//|#|\*)")


def is_description(text: Column, trimmed: Column) -> Column:
    return any_of(F.lower(text), DESCRIPTIONS) | (trimmed.startswith('("') & trimmed.contains("_assign"))


def value_of(text: Column) -> Column:
    """What follows the first equals sign, or else the first colon, without white space at its ends."""
    after = F.when(text.contains("="), F.regexp_extract(text, "^[^=]*=(.*)$", 1)).otherwise(F.regexp_extract(text, "^[^:]*:(.*)$", 1))
    return F.regexp_replace(after, r"^\s+|\s+$", "")


def looks_secret(value: Column) -> Column:
    """Neither empty, nor a bare or quoted keyword, nor a long description."""
    quoted = value.rlike("^[\"']")
    inner = F.regexp_replace(value, '^[";,]+|[";,]+$', "")
    prose = value.startswith('"') & (F.octet_length(value) > 40) & reduce(or_, [inner.startswith(p) for p in PROSE])
    return (value != "") & ~F.lower(value).isin(*KEYWORDS) & ~(quoted & F.lower(inner).isin(*KEYWORDS)) & ~prose


def is_markup(literal: Column) -> Column:
    low = F.lower(literal)
    return reduce(add, [low.contains(m).cast("int") for m in MARKUP]) >= 2


def is_code(literal: Column) -> Column:
    return any_of(F.lower(literal), CODE)


def is_format(literal: Column) -> Column:
    """A format string, or a long text of plain words."""
    plain = F.regexp_replace(literal, '^"+|"+$', "")
    return any_of(plain, FORMATS) | ((F.octet_length(plain) > 100) & any_of(F.lower(plain), COMMON_WORDS) & any_of(plain, PUNCTUATION))


def literals(text: Column) -> Column:
    """The quoted literals of a line, escaped characters left out."""
    both = F.zip_with(F.regexp_extract_all(text, F.lit(LITERAL), 1), F.regexp_extract_all(text, F.lit(LITERAL), 2), lambda a, b: F.concat(a, b))
    return F.transform(both, lambda x: F.regexp_replace(x, r"\\.?", ""))


def secrets(lines: DataFrame, least_entropy: float = 4.5) -> DataFrame:
    """(file, line, kind, pattern, severity, entropy) of lines (path, line, text, trimmed): the first keyword of a
    line that assigns what looks like a secret, and every literal of high entropy. Examples and comments are
    left out, and of literals markup, code and format strings."""
    live = lines.filter(~is_example(F.col("text"), F.col("trimmed")))
    text, t = F.col("text"), F.col("trimmed")
    rule = first_match(F.lower(text), SECRETS)
    assigned = live.filter((text.contains("=") | text.contains(":")) & ~is_description(text, t) & looks_secret(value_of(text))).withColumn("rule", rule).filter("rule is not null")
    n = F.col("rule")
    patterns = assigned.select(F.col("path").alias("file"), "line", F.lit("pattern").alias("kind"), attribute(n, SECRETS, "id").alias("pattern"), attribute(n, SECRETS, "severity").alias("severity"), F.lit(None).cast("double").alias("entropy"))
    each = live.select(F.col("path").alias("file"), "line", F.explode(literals(text)).alias("literal"))
    lit = F.col("literal")
    scored = each.filter((F.octet_length(lit) >= LEAST_BYTES) & ~is_markup(lit) & ~is_code(lit) & ~is_format(lit)).withColumn("entropy", F.round(metrics.entropy(lit), 6)).filter(F.col("entropy") >= least_entropy)
    found = scored.select("file", "line", F.lit("entropy").alias("kind"), F.lit("high_entropy_string").alias("pattern"), F.when(F.col("entropy") >= HIGH, "high").otherwise("medium").alias("severity"), "entropy")
    return patterns.unionByName(found)
