"""Fixers and patches on single lines and overlapping intervals."""

from quillwork.operators import fixes
from quillwork.sources import corpus


def patched(spark, *lines, rules=fixes.RULES):
    df = spark.createDataFrame([("a.rs", "\n".join(lines))], "path string, content string")
    return [(r.line, r.rule_id, r.new_text) for r in fixes.proposals(corpus.lines(df, "before"), rules).orderBy("line", "ord").collect()]


def test_error_handling(spark):
    assert patched(spark, "fn test() { let x = get_value().unwrap(); }", rules=("errhandle",)) == [(1, "errhandle-unwrap", "fn test() { let x = get_value()?; }")]
    assert patched(spark, "// let x = get_value().unwrap();", '    let s = "a.unwrap()";', "#[case(x.unwrap())]") == []
    assert patched(spark, r'  a(b("(")).expect("it \") is").c()') == [(1, "errhandle-expect", r'  a(b("(")).map_err(|e| format!("it \") is: {e}"))?.c()')]
    assert patched(spark, "  open(x).expect(one(two(three(4)))) ;", "  open(x).expect(never(closed)") == [(1, "errhandle-expect", '  open(x).map_err(|e| { "one(two(three(4))): {e}".to_string() })? ;')]


def test_dead_code_and_debt(spark):
    assert patched(spark, "fn unused_function() {}") == [(1, "deadcode-annotate", "#[allow(dead_code)]\nfn unused_function() {}")]
    assert patched(spark, "pub(crate) fn used() {}", "#[test]", "fn t() {}", rules=("deadcode",)) == []
    assert patched(spark, "// TODO: implement this") == [(1, "debt-track", "// TODO:(#0): implement this")]
    assert patched(spark, "// TODO(#42): implement this", "// TODO:(#0): again", 'let x = "a TODO: b";') == []


def test_crypto_secrets_and_documentation(spark):
    assert patched(spark, "let hash = md5::compute(data);") == [(1, "crypto-weak-hash", "let hash = sha2::Sha256::digest(data);")]
    assert patched(spark, 'let api_key = "abc";', 'let apikey = "abcdef";', 'static TOKEN: &str = "http://x";') == [(1, "secrets-literal", 'let api_key = std::env::var("API_KEY")?;'), (2, "secrets-env", 'let apikey = std::env::var("API_KEY")?;')]
    assert patched(spark, "  pub enum Kind<T> {") == [(1, "doccov-stub", "  /// TODO: document `Kind<T`\n  pub enum Kind<T> {")]


def applied(spark, content, patches):
    files = spark.createDataFrame([("a", content), ("b", None)], "path string, content string")
    rows = spark.createDataFrame([("a", line, i, old, new) for i, (line, old, new) in enumerate(patches)], "file string, line int, ord int, old_text string, new_text string")
    got = {r.path: (r.content, r.n_applied, r.n_rejected) for r in fixes.applied(files, rows).collect()}
    assert got["b"] == (None, 0, 0)
    return got["a"]


def test_overlapping_patches(spark):
    text = "one\ntwo\r\nthree\nfour\n"
    assert applied(spark, text, [(2, "two\nthree", "2\n3\nmore"), (3, "three", "III"), (4, "four", "")]) == ("one\ntwo\nIII", 2, 1)
    assert applied(spark, text, [(2, "two\nthree", "2"), (1, "one", "1\n1.5"), (1, "one", "first")]) == ("1\n1.5\n2\nfour", 2, 1)
    assert applied(spark, text, [(2, "else", "x"), (9, "four", "x"), (0, "one", "x")]) == (text, 0, 3)


def test_unsound_results_are_not_taken(spark):
    assert applied(spark, "f(1)\ng()", [(1, "f(1)", "f(1"), (2, "g()", "h()")]) == ("f(1)\ng()", 0, 2)
    assert applied(spark, "f(1)\ng()", [(1, "f(1)", "f(2)"), (2, "g()", "h()")]) == ("f(2)\nh()", 2, 0)
