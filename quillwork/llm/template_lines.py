"""Line dedup by a log-template tree of fixed depth.

The tree's levels are a line's token count and its first LEAD tokens (what stands between white space
of any kind), tokens with digits taken as the variable ``<*>``. A leaf's templates are found from all
of its lines at once instead of line by line, so that they don't depend on any order: a token is
constant at its position if lines of the leaf hold it there that MIN_DOCS texts stand behind, and
variable otherwise. Lines of which at least SIMILARITY is constant fall under the template of their
constants, the others under themselves. A template that different texts of at least MIN_DOCS documents
hold recurs, and its lines are dropped, except in the text that has the least id: repeated rows and
exact copies of one text count once.

Lines of LEAD tokens or fewer (mostly so lines of unsegmented scripts) and lines of LONG tokens or more
have no template but themselves, digits aside; long ones, which don't recur by chance, are dropped from
LONG_DOCS texts on. Tokens with digits are left aside only where they are few: a line of which less than
SIMILARITY would be left, as a row of numbers, is counted as it stands.

Only DataFrame functions are used. Lines travel as hashes: 128 bits of a text, a leaf's 64 bits and 64
of the line within its leaf. Words of lines are shuffled only for the lines between LEAD and LONG tokens,
once for each distinct line. Null text stays null; empty lines are kept; null ids come first. Texts that
lose lines keep the others' order. Repeated rows lose the same lines; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEAD, MIN_DOCS, SIMILARITY = 3, 5, 0.7
LONG, LONG_DOCS = 50, 2
VARIABLE = "<*>"
#: White space within a line, of any script: tab, feeds, separators and all Unicode spaces.
SPACES = r"[\t\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
#: What becomes one blank: a single blank, which is by far the most frequent, isn't matched at all.
SPACE = rf"{SPACES}(?:(?<! ){SPACES}*|{SPACES}+)"
KEY, LINE = ["k1", "k2"], ["leaf", "h"]


def _masked(line: Column) -> Column:
    """Tokens that hold a digit become the variable; tried at token starts only, without backtracking."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", VARIABLE)).otherwise(line)


def _times(line: Column, part: str) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(part), F.lit("")))) / len(part)


def _variables(line: Column) -> Column:
    return _times(line, VARIABLE)


def _key(text: Column) -> list[Column]:
    """128 bits of a text: two hashes that begin with different seeds."""
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def _lines(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(k1, k2, id, pos, n, masked, leaf, h) of the lines that aren't empty. h is of the line with white space
    as single blanks and tokens with digits masked where they are few; masked is null where no template is
    looked for."""
    text = F.col(text_col).cast("string")
    texts = df.filter(text.isNotNull()).select(*_key(text), F.col(id_col).alias("id"), F.regexp_replace(text, SPACE, " ").alias("text"))
    raw = texts.select(*KEY, "id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select(*KEY, "id", "pos", F.trim("raw").alias("line"))
    lines = raw.filter("line <> ''").withColumn("n", _times(F.col("line"), " ").cast("int") + 1).withColumn("masked", _masked(F.col("line")))
    form = F.when(_variables(F.col("masked")) <= (1 - SIMILARITY) * F.col("n"), F.col("masked")).otherwise(F.col("line"))
    leaf = F.xxhash64("n", F.substring_index("masked", " ", LEAD))
    return lines.select(*KEY, "id", "pos", "n", F.when(_between(F.col("n")), F.col("masked")).alias("masked"), leaf.alias("leaf"), F.xxhash64(F.lit(3), form).alias("h"))


def _between(n: Column) -> Column:
    return (n > LEAD) & (n < LONG)


def _least(n: Column) -> Column:
    return F.when(n >= LONG, LONG_DOCS).otherwise(MIN_DOCS)


def _templates(lines: DataFrame, counted: DataFrame) -> DataFrame:
    """(leaf, h, x1, x2): the distinct lines between LEAD and LONG tokens that fall under a template, which
    leaf, x1 and x2 name. counted: (leaf, h, n, texts) of all distinct lines."""
    open_lines = counted.filter(_between(F.col("n")))
    # a leaf whose lines fewer than MIN_DOCS texts stand behind holds no template
    leaves = open_lines.groupBy("leaf").agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= MIN_DOCS).select("leaf")
    candidates = open_lines.join(leaves, "leaf", "left_semi").select(*LINE, "texts")
    words = lines.filter("masked is not null").groupBy(*LINE).agg(F.first("masked").alias("masked")).join(candidates, LINE)
    tokens = F.split("masked", " ")
    lead = LEAD - _variables(F.substring_index("masked", " ", LEAD))
    need = F.ceil(F.round(SIMILARITY * F.size(tokens) - lead, 6)).cast("int")
    spots = words.select(*LINE, "texts", need.alias("need"), F.posexplode(F.slice(tokens, LEAD + 1, LONG)).alias("at", "token"))
    spots = written(spots.filter(F.col("token") != VARIABLE).select(*LINE, "texts", "need", F.xxhash64("leaf", "at", "token").alias("spot")))
    constant = spots.groupBy("spot").agg(F.sum("texts").alias("support")).filter(F.col("support") >= MIN_DOCS).select("spot")
    found = spots.join(constant, "spot").groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("constants"), F.min("need").alias("need"), F.bit_xor("spot").alias("x1"), F.bit_xor(F.xxhash64(F.lit(4), "spot")).alias("x2"),
    )
    return found.filter("constants >= need").select(*LINE, "x1", "x2")


def _recurring(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(k1, k2, drop array<int>): line positions to drop by text."""
    lines = written(_lines(df, text_col, id_col))
    found = lines.drop("masked")
    by_text = found.groupBy(*LINE, "n", *KEY).agg(F.lit(1).alias("one"))
    counted = written(by_text.groupBy(*LINE, "n").agg(F.count(F.lit(1)).alias("texts")).filter((F.col("n") < LONG) | (F.col("texts") >= LONG_DOCS)), narrow=True)
    named = _templates(lines, counted).select(*LINE, "x1", "x2", F.lit(MIN_DOCS).alias("least"))
    literal = counted.filter(F.col("texts") >= _least(F.col("n"))).select(*LINE, F.col("h").alias("x1"), F.lit(0).cast("long").alias("x2"), _least(F.col("n")).alias("least"))
    # a line under a template is dropped with it; what recurs as it stands and has none is a group by itself
    groups = named.withColumn("literal", F.lit(0)).unionByName(literal.withColumn("literal", F.lit(1)))
    group = F.min(F.struct("literal", "x1", "x2", "least")).alias("g")
    groups = groups.groupBy(*LINE).agg(group).select(*LINE, "g.literal", "g.x1", "g.x2", "g.least")
    members = written(found.join(groups, LINE).select("leaf", "literal", "x1", "x2", "least", *KEY, "id", "pos"), narrow=True)
    name = ["leaf", "literal", "x1", "x2"]
    holders = members.groupBy(*name, "least", *KEY).agg(F.min("id").alias("id"))
    again = holders.groupBy(*name, "least").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("id", *KEY)).alias("first")).filter("texts >= least")
    again = again.select(*name, F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"))
    drops = members.join(again, name).filter((F.col("k1") != F.col("f1")) | (F.col("k2") != F.col("f2")))
    return drops.groupBy(*KEY).agg(F.collect_set("pos").alias("drop"))


def _with_drops(df: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, list[str]]:
    """df's columns as c0, c1 and so on, the text's lines and the positions to drop, null if none."""
    names = df.columns
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    text, key = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    # written first, so that a text of very many copies can be split in the join
    drops = written(_recurring(renamed, text, key), narrow=True)
    joined = renamed.select("*", *_key(F.col(text).cast("string"))).join(drops, KEY, "left")
    return joined.withColumn("lines", F.split(F.col(text), "\n")), names


def _kept(text: Column) -> Column:
    """The text without the lines to drop, in time in proportion to its lines."""
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    return F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))


def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = None) -> DataFrame:
    """The same rows and columns, recurring lines gone from the text; length_col gets the new length."""
    joined, names = _with_drops(df, text_col, id_col)
    made = _kept(F.col(f"c{names.index(text_col)}"))
    out = []
    for i, name in enumerate(names):
        column = made if name == text_col else F.when(F.col("drop").isNotNull(), F.length(made)).otherwise(F.col(f"c{i}")).cast(df.schema[name].dataType) if name == length_col else F.col(f"c{i}")
        out.append(column.alias(f"c{i}"))
    return joined.select(*out).toDF(*names)


def line_report(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines long, n_dropped long, text_sha256 string of what stays; null text: no lines)."""
    joined, _ = _with_drops(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", "doc_id")
    text = F.col("c1")
    return joined.select(
        F.col("c0").alias("doc_id"),
        F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(_kept(text), F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
