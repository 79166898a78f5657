"""Corpora as (path, content) tables, and what is derived from them line by line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_state import lines, trim  # noqa: F401  (part of this module's surface)

# File extensions and their languages.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go",
    "java": "java", "c": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift",
    "sol": "solidity", "sh": "bash", "kt": "kotlin",
}
#: Directories whose descendants are never scanned; so are those whose name begins with a dot.
SKIPPED_DIRS = ("target", ".git", "node_modules", "fixtures")
# Where coverage files are looked for, in order.
LCOV_PLACES = ("target/lcov.info", "lcov.info", "coverage.lcov", "target/coverage/lcov.info", "coverage/lcov.info")

#: Lines of the synthetic source corpus: file p takes line j's template number (p * (2 j + 1) + j) mod 23.
TEMPLATES = (
    "fn step(value: u32) -> u32 {", "    let out = value.checked_add(1).unwrap();", "    // TODO: split this function",
    "    println!(out);", "", "/* old code", "    eval(source)", "*/", "    let key = Md5::digest(data);",
    '    password = "hunter22"', '    token = "abcdef"', "    # FIXME later", "    let _ = run();", "}",
    "    let db_password = env;", "    let t = SystemTime::now();", "use tracing::info;", "    unsafe {",
    '    panic!("no way");', "    console.log(value)", "    Access-Control-Allow-Origin: *", "#[get(/items)]",
    "    x.expect(reason) // HACK and BUG",
)
TEMPLATE_LINES = 24
EXTENSIONS = ("rs", "py", "js", "go", "java", "md")


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    """Whole text files below root, or root itself, as (path, content, ext, lang), in no order: skipped folders
    are pruned below root only, and extensions are matched before a file is read."""
    reader = spark.read.option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    raw = reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return with_language(without(prune(raw, root), excluded))


def prune(files: DataFrame, root: str = "") -> DataFrame:
    """Without the descendants of skipped folders; folders above root don't matter."""
    names = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    path = F.col("path")
    below = F.regexp_replace(path, f"^(?:[a-z0-9]+:/*)?{re.escape('/' + root.split(':', 1)[-1].strip('/'))}(?=/)", "") if root else path
    return files.filter(~below.rlike(rf"(?:^|/)(?:{names}|\.[^/]+)/"))


def without(files: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Without the files whose path contains one of parts: what a user excludes, or a scanner's own sources."""
    for p in parts:
        files = files.filter(~F.col("path").contains(p))
    return files


def workspace_root(spark: SparkSession, root: str) -> str:
    """root/crates if root's manifest declares a workspace and that folder is there, else root."""
    fs, at = _file_system(spark, root)
    manifest, members = f"{root.rstrip('/')}/Cargo.toml", f"{root.rstrip('/')}/crates"
    if not fs.exists(at(manifest)) or not fs.exists(at(members)):
        return root
    declared = spark.read.text(manifest).filter(trim(F.col("value")).startswith("[workspace]")).limit(1).count()
    return members if declared else root


def lcov_file(spark: SparkSession, root: str) -> str | None:
    """The first of the usual places of a coverage file that is there."""
    fs, at = _file_system(spark, root)
    return next((p for p in (f"{root.rstrip('/')}/{c}" for c in LCOV_PLACES) if fs.exists(at(p))), None)


def _file_system(spark: SparkSession, root: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(root).getFileSystem(spark._jsc.hadoopConfiguration()), at


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def with_language(files: DataFrame) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return files.withColumn("ext", extension(F.col("path"))).withColumn("lang", F.coalesce(F.try_element_at(pairs, F.lower("ext")), F.lit("unknown")))


#: Keys that one task makes files of, and the least that are worth a task of their own. A key takes a few bytes on disk
#: and its file a thousand times as many, so that tasks dealt by bytes would be few, and each would hold most of the work.
FILES, FEW_FILES = 10_000, 1_000


def spread(keys: DataFrame) -> DataFrame:
    """All keys, dealt evenly to as many tasks as the files made of them need. What counts them reads no column."""
    n = keys.select().count()
    wanted = max(-(-n // FILES), min(keys.sparkSession.sparkContext.defaultParallelism, -(-n // FEW_FILES)))
    return keys.repartition(max(wanted, 1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic source tree, one file for each part."""
    p = F.col("p_partkey")
    table = F.array(*[F.lit(t) for t in TEMPLATES])
    numbers = F.sequence(F.lit(0), F.lit(TEMPLATE_LINES - 1))
    lines = F.transform(numbers, lambda j: F.element_at(table, (F.pmod(p * (j * 2 + 1) + j, F.lit(len(TEMPLATES))) + 1).cast("int")))
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.pmod(p, F.lit(len(EXTENSIONS))) + 1).cast("int"))
    kind = F.when(F.pmod(p, F.lit(7)) == 0, "tests/test_").otherwise("src/unit_")
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"))
    return parts.select(F.concat(kind, p.cast("string"), F.lit("."), ext).alias("path"), F.concat_ws("\n", lines).alias("content"))


def demangled(symbol: Column) -> Column:
    """The last identifier of a mangled symbol (``_R``, identifiers each behind its length), else the symbol. What
    an identifier takes up isn't looked at again: a step for each run of digits reads on from where it ends."""
    state = F.struct(symbol.alias("rest"), F.lit(None).cast("string").alias("last"))

    def step(at: Column, _: Column) -> Column:
        after = F.regexp_extract(at["rest"], r"^[^0-9]*[0-9]+(.*)$", 1)
        n = F.regexp_extract(at["rest"], r"^[^0-9]*([0-9]+)", 1).try_cast("int")
        fits, name = F.coalesce(F.length(after) >= n, F.lit(False)), F.left(after, n)
        last = F.when(fits & name.rlike(r"^\w*$"), name).otherwise(at["last"])
        return F.struct(F.when(fits, F.substr(after, n + 1)).otherwise(after).alias("rest"), last.alias("last"))

    last = F.aggregate(F.regexp_extract_all(symbol, F.lit("[0-9]+"), 0), state, step, lambda at: at["last"])
    return F.when(symbol.startswith("_R"), F.coalesce(last, symbol)).otherwise(symbol)


def lcov(records: DataFrame) -> DataFrame:
    """(function, line, hits) of LCOV lines (value): hits summed by name, the least FN line. A mangled symbol is
    also counted under its plain name."""
    v = trim(F.col("value"))
    kind, number, raw = (F.regexp_extract(v, r"^(FN|FNDA):(\d+),(.*)$", k) for k in (1, 2, 3))
    each = records.select(kind.alias("kind"), number.alias("number"), raw.alias("raw")).filter("kind <> ''")
    names = each.select("kind", F.col("number").cast("long").alias("number"), F.explode(F.array_distinct(F.array("raw", demangled(F.col("raw"))))).alias("function"))
    hits = F.coalesce(F.sum(F.when(F.col("kind") == "FNDA", F.col("number"))), F.lit(0)).alias("hits")
    return names.groupBy("function").agg(F.min(F.when(F.col("kind") == "FN", F.col("number"))).cast("int").alias("line"), hits).select("function", "line", "hits")


def locked_packages(rows: DataFrame) -> DataFrame:
    """(path, name, version, source, checksum) of lock file lines: sections are numbered by a running
    count of their headers, then each section is one group."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line")
    numbered = rows.withColumn("section", F.sum(F.when(F.col("trimmed") == "[[package]]", 1).otherwise(0)).over(w)).filter(F.col("section") > 0)
    value = lambda k: F.max(F.when(F.col("trimmed").startswith(f"{k} = "), F.regexp_extract("trimmed", '= "([^"]*)"', 1))).alias(k)
    return numbered.groupBy("path", "section").agg(value("name"), value("version"), value("source"), value("checksum")).drop("section")
