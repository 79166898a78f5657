"""Registered queries over proposed fixes: patches, their diffs, and files with patches applied.

The generated tree's lines are dealt to files by the part's key. What each of them has to give was written down by hand;
the SQL looks lines up in that table, and at the line above where a rule does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fixes
from ..sources import corpus
from .catalog import LINES, parts, register, text

#: Lines, and the patches (ord, rule, confidence, new text, whether the line above decides) that each one gives.
EXPECTED = {
    "fn helper(x: u32) -> u32 {": ((1, "deadcode-annotate", "high", "#[allow(dead_code)]\nfn helper(x: u32) -> u32 {", "attribute"),),
    "    async fn run() {": ((1, "deadcode-annotate", "high", "    #[allow(dead_code)]\n    async fn run() {", "attribute"),),
    "#[inline]": (),
    "#[allow(dead_code)]": (),
    "    let a = parse(x).unwrap();": ((0, "errhandle-unwrap", "medium", "    let a = parse(x)?;", ""),),
    '    let b = read(path).expect("no (file");': ((0, "errhandle-expect", "medium", '    let b = read(path).map_err(|e| format!("no (file: {e}"))?;', ""),),
    "    let c = f(g(1)).expect(name(2)).len();": ((0, "errhandle-expect", "medium", '    let c = f(g(1)).map_err(|e| { "name(2): {e}".to_string() })?.len();', ""),),
    "    first.unwrap(); second.expect(it)": ((0, "errhandle-unwrap", "medium", "    first?; second.expect(it)", ""),),
    "    // done.unwrap()": (),
    '    let q = "x.unwrap()";': (),
    "    // TODO: split this": ((2, "debt-track", "high", "    // TODO:(#0): split this", ""),),
    "    // fixme:   soon": ((2, "debt-track", "high", "    // FIXME:(#0): soon", ""),),
    "    // FIXME: (known)": (),
    "    let n = 1; // HACK: later": ((2, "debt-track", "high", "    let n = 1; // HACK:(#0): later", ""),),
    '    let s = "TODO: no comment";': (),
    '    let token = "abcd1234";': ((3, "secrets-env", "low", '    let token = std::env::var("TOKEN")?;', ""),),
    '    const SECRET: &str = "s3cretvalue";': ((3, "secrets-env", "low", '    const SECRET: String = std::env::var("SECRET").expect("SECRET must be set");', ""),),
    '    let password = "your-password";': (),
    '    let mut my_key = "0123456789";': ((3, "secrets-literal", "low", '    let my_key = std::env::var("MY_KEY")?;', ""),),
    '    let k = "AKIA0123456789";': (),
    "    let h = md5::compute(data);": ((4, "crypto-weak-hash", "medium", "    let h = sha2::Sha256::digest(data);", ""),),
    "use md5;": ((5, "crypto-weak-hash", "high", "use sha2::{Sha256, Digest};", ""),),
    "use sha1::Sha1;": ((4, "crypto-weak-hash", "medium", "use sha2::Sha256;", ""), (5, "crypto-weak-hash", "high", "use sha2::{Sha256, Digest};", "")),
    "    let r = rand::thread_rng().unwrap();": ((0, "errhandle-unwrap", "medium", "    let r = rand::thread_rng()?;", ""), (4, "crypto-weak-rng", "medium", "    let r = rand::rngs::OsRng.unwrap();", "")),
    "    let key = rand::random();": ((4, "crypto-weak-rng", "low", "    let key = rand::rngs::OsRng.gen();", ""),),
    "    let dice = rand::random();": (),
    "use rand;": ((5, "crypto-weak-rng", "high", "use rand::rngs::OsRng;\nuse rand::RngCore;", ""),),
    "pub fn open(path: &str) {": ((6, "doccov-stub", "high", "/// TODO: document `open(path`\npub fn open(path: &str) {", "document"),),
    "    pub struct Point {": ((6, "doccov-stub", "high", "    /// TODO: document `Point`\n    pub struct Point {", "document"),),
    "/// Documented.": (),
    "}": (),
    "": (),
}
#: A line whose patch would leave a bracket open: its file keeps its text. Every fifth file ends in it.
UNSOUND = '    connect(key="live", || {'
UNSOUND_FIX = (3, "secrets-literal", "low", '    let  = std::env::var("SECRET")?;', "")
ALL = list(EXPECTED)
COUNT, STEP, EXTENSIONS = 18, len(ALL), ("rs", "rs", "py")
FILES = f"""files AS (SELECT 'fix/u' || p_partkey || '.' || ({list(EXTENSIONS)!r})[1 + p_partkey % {len(EXTENSIONS)}] AS path,
    array_to_string([([{', '.join(map(text, ALL))}])[1 + (p_partkey * (3 * j + 1) + j * j) % {STEP}] FOR j IN range({COUNT})] || CASE WHEN p_partkey % 5 = 0 THEN [{text(UNSOUND)}] ELSE [] END, chr(10)) AS content FROM part)"""
ROWS = ", ".join(f"({text(old)}, {o}, '{rule}', '{conf}', {text(new)}, '{how}')" for old, made in (*EXPECTED.items(), (UNSOUND, (UNSOUND_FIX,))) for o, rule, conf, new, how in made)
PATCHES = f"""{FILES}, {LINES}, a AS (SELECT *, coalesce(lag(trimmed) OVER (PARTITION BY path ORDER BY line), '') AS above FROM lines),
    patches AS (SELECT path AS file, line, ord, rule_id, confidence, text AS old_text, new_text FROM a JOIN (VALUES {ROWS}) v(old_text, ord, rule_id, confidence, new_text, how) ON text = v.old_text
        WHERE ends_with(path, '.rs') AND NOT (how = 'attribute' AND above IN ('#[inline]', '#[allow(dead_code)]')) AND NOT (how = 'document' AND above = '/// Documented.'))"""


def fix_tree(spark, sf_dir):
    p = F.col("p_partkey")
    table, ext = F.array(*map(F.lit, ALL)), F.array(*map(F.lit, EXTENSIONS))
    lines = F.transform(F.sequence(F.lit(0), F.lit(COUNT - 1)), lambda j: F.element_at(table, (F.pmod(p * (j * 3 + 1) + j * j, F.lit(STEP)) + 1).cast("int")))
    lines = F.concat(lines, F.when(p % 5 == 0, F.array(F.lit(UNSOUND))).otherwise(F.array().cast("array<string>")))
    name = F.concat(F.lit("fix/u"), p.cast("string"), F.lit("."), F.element_at(ext, (F.pmod(p, F.lit(len(EXTENSIONS))) + 1).cast("int")))
    return parts(spark, sf_dir).select(name.alias("path"), F.concat_ws("\n", lines).alias("content"))


def found(spark, sf_dir):
    return fixes.proposals(corpus.lines(fix_tree(spark, sf_dir), "before"))


@register("proposed_fixes", f"WITH {PATCHES} SELECT * FROM patches")
def proposed_fixes(spark, sf_dir):
    return found(spark, sf_dir)


@register("fix_diffs", rf"""WITH {PATCHES}, d AS (SELECT file, line, rule_id, old_text, new_text, len(string_split(new_text, chr(10))) AS n FROM patches)
    SELECT file, line, rule_id, '--- ' || file || chr(10) || '+++ ' || file || chr(10) || '@@ -' || line || ' +' || line || CASE WHEN n > 1 THEN ',' || n ELSE '' END || ' @@' || chr(10) || '-' || old_text || chr(10) || '+' || array_to_string(string_split(new_text, chr(10)), chr(10) || '+') || chr(10) AS diff FROM d""")
def fix_diffs(spark, sf_dir):
    return fixes.diffs(found(spark, sf_dir))


@register("fixed_files", f"""WITH {PATCHES}, best AS (SELECT file, line, arg_min(new_text, ord) AS new_text, count(*) AS n FROM patches GROUP BY ALL),
    made AS (SELECT path, string_agg(coalesce(new_text, text), chr(10) ORDER BY lines.line) AS content, count(new_text) AS kept, sum(n)::BIGINT AS n, bool_or(text = {text(UNSOUND)} AND ends_with(path, '.rs')) AS unsound FROM lines LEFT JOIN best ON file = path AND best.line = lines.line GROUP BY path)
    SELECT path, CASE WHEN kept > 0 AND NOT unsound THEN made.content ELSE files.content END AS content, CASE WHEN unsound THEN 0 ELSE kept END::INT AS n_applied, (coalesce(n, 0) - CASE WHEN unsound THEN 0 ELSE kept END)::INT AS n_rejected
    FROM files JOIN made USING (path)""")
def fixed_files(spark, sf_dir):
    return fixes.applied(fix_tree(spark, sf_dir), found(spark, sf_dir))
