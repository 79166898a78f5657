"""Halstead measures by file, with a tokeniser of regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that count as operators.
KEYWORDS = (
    "if", "else", "for", "while", "loop", "match", "switch", "case", "return", "break", "continue", "fn", "func", "function", "def", "let", "var", "const",
    "mut", "pub", "use", "import", "from", "class", "struct", "enum", "impl", "trait", "type", "interface", "new", "delete", "await", "async", "yield", "try",
    "catch", "finally", "throw", "raise", "with", "in", "as", "is", "not", "and", "or", "true", "false", "nil", "null", "None", "True", "False",
)
TOKEN = r"""("[^"]*"?|'[^']*'?|[\p{L}\p{N}_]+|[-+*/%=<>!&|^~?:;,.()\[\]{}@][=>]?)"""


def halstead(lines: DataFrame) -> DataFrame:
    """(file, n1, n2, total1, total2, volume, difficulty, bugs, time): a comment ends a line (# only does where
    there is no //), a string is one operand, a symbol takes a following = or > along."""
    code = F.when(F.col("text").contains("//"), F.substring_index("text", "//", 1)).otherwise(F.substring_index("text", "#", 1))
    tokens = lines.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all(code, F.lit(TOKEN), 1)).alias("t"))
    word = F.col("t").rlike(r"^[\p{L}\p{N}_]")
    kind = F.when(F.col("t").rlike("^[\"']"), "operand").when(word & ~F.col("t").isin(*KEYWORDS), "operand").otherwise("operator")
    name = F.when(F.col("t").rlike("^[\"']"), "__literal__").otherwise(F.col("t"))
    by = tokens.select("file", kind.alias("kind"), name.alias("name")).groupBy("file", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    distinct = lambda k: F.count(F.when(F.col("kind") == k, 1))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    sums = by.groupBy("file").agg(distinct("operator").alias("n1"), distinct("operand").alias("n2"), total("operator").alias("total1"), total("operand").alias("total2"))
    volume = (F.col("total1") + F.col("total2")) * F.log2((F.col("n1") + F.col("n2")).cast("double"))
    difficulty = F.when(F.col("n2") > 0, F.col("n1") / 2 * F.col("total2") / F.col("n2")).otherwise(0.0)
    full = sums.withColumn("volume", F.round(volume, 6)).withColumn("difficulty", F.round(difficulty, 6))
    return full.withColumn("bugs", F.round(F.col("volume") / 3000, 6)).withColumn("time", F.round(F.col("difficulty") * F.col("volume") / 18, 6))
