"""Heads over several lines, and documentation that is attached to an item."""

from quillwork.operators import grammar, parse, surface
from quillwork.plans import catalog_grammar
from quillwork.sources import corpus


def lines(spark, path, text, *states):
    return corpus.lines(spark.createDataFrame([(path, text)], "path string, content string"), *states)


def test_heads_end_where_their_bracket_closes(spark):
    text = "// fn no(\npub fn a(\n    x: u8, // one)\n    y: fn(u8) -> u8,\n) -> u8 {\n    b(1)\n}\nfn b(\nfn c(s: &str) {}\ndef d(x=')',\n\n  y=1):\n  pass"
    got = [r.head for r in lines(spark, "a.rs", text, "head").orderBy("line").collect()]
    assert got[0] == "// fn no(" and got[1] == "pub fn a( x: u8, // one) y: fn(u8) -> u8, ) -> u8 {"
    assert got[2:5] == ["x: u8, // one)", "y: fn(u8) -> u8,", ") -> u8 {"]
    assert got[7] == "fn b(" and got[8] == "fn c(s: &str) {}" and got[9] == "def d(x=')',  y=1):"
    assert lines(spark, "e.rs", "", "head").count() == 0 and lines(spark, "n.rs", None, "head").count() == 0


def test_signatures_of_the_fuzz_surface(spark):
    def score(path, text):
        rows = surface.whole_heads(lines(spark, path, text, "head"))
        none = spark.createDataFrame([], "file string, name string, line int, complexity int")
        return [(r.name, r.score, r.public) for r in surface.fuzz_surface(rows, surface.harness_names(rows), none).collect()]

    assert score("t.rs", "pub fn parse_data(data: &[u8]) -> Result<String, Error> { }") == [("parse_data", 42, True)]
    assert score("t.rs", "pub fn parse_data(\n    data: &[u8],\n    n: usize\n) -> Result<String, Error> { }") == [("parse_data", 44, True)]
    assert score("t.rs", "fn internal_helper(x: i32) -> i32 { }") == []
    assert score("t.py", "def process_data(\n    data: bytes\n) -> str:") == [("process_data", 32, True)]


def test_check_and_tool_count_documentation_differently(spark):
    text = "/// Of a.\n#[inline]\n// note\npub fn a() {}\npub fn b() {}\n/** Of c\n * more\n */\npub(crate) fn c() {}\n/// Of d.\npub async fn d() {}\nimpl S {\n    #[doc = \"x\"]\n    pub unsafe fn e() {}\n    pub fn f() {}\n}"
    found = lines(spark, "a.rs", text, "above", "after", "attached")
    check = {r.line: r.documented for r in surface.attached_items(found).collect()}
    tool = {r.line: r.documented for r in surface.documented_items(found).collect()}
    assert check == {4: True, 5: False, 11: True, 14: True, 15: False}
    assert tool[5] and not check[5]  # four lines above, whatever stands between


def test_functions_of_brace_and_end_languages():
    names = lambda s, lang: [(n, c) for n, _, _, c in grammar.functions(s, lang)]
    assert names("fn add(a: i32, b: i32) -> i32 { a + b }", "rust") == [("add", 1)]
    assert names("fn classify(x: i32) -> &'static str {\n if x > 0 { \"p\" } else if x < 0 { \"n\" } else { \"z\" }\n}", "rust") == [("classify", 5)]
    assert names("function greet(name) { if (name) { return 'hi ' + name; } return 'hi'; }", "javascript") == [("greet", 2)]
    assert names("package main\nfunc add(a, b int) int { return a + b }\n", "go") == [("add", 1)]
    assert names("def add(a, b)\n  a + b\nend\n", "ruby") == [("add", 1)]
    assert names("def classify(x)\n  if x > 0\n    'p'\n  elsif x < 0\n    'n'\n  else\n    'z'\n  end\nend\n", "ruby") == [("classify", 3)]
    assert names("func add(a: Int, b: Int) -> Int { return a + b }\n", "swift") == [("add", 1)]
    assert names("fun add(a: Int, b: Int): Int = a + b\n", "kotlin") == [("add", 1)]
    for lang in grammar.LANGUAGES:
        assert grammar.functions("", lang) == [] and grammar.functions("{{{ ((( '\"` /* ", lang) == []
    assert len(names("fn f() {" * 2000 + "}" * 1999, "rust")) == 2000
    assert parse.python_functions("@a(lambda: 1)\nclass T:\n    def f(self): pass\n") == [("<anonymous>", 1, 3, 2), ("f", 3, 3, 1)]


def split_heads(spark, folder):
    """(key, head) of a table of parts with every way in which a head is cut, far from the first keys."""
    spark.range(2**40, 2**40 + 120).withColumnRenamed("id", "p_partkey").write.parquet(f"{folder}/part.parquet")
    return [(k, catalog_grammar.HEADS[k % len(catalog_grammar.HEADS)]) for k in range(2**40, 2**40 + 120)]


def test_split_heads_are_fuzzed_whole(spark, tmp_path):
    heads = split_heads(spark, tmp_path)
    assert catalog_grammar.head_tree(spark, str(tmp_path)).count() == len(heads)
    found = sorted(tuple(r) for r in catalog_grammar.split_heads_fuzzed(spark, str(tmp_path)).collect())
    assert found == sorted((f"h/u{k}.{h[0]}", 2, h[4], h[5]) for k, h in heads if h[5] is not None)


def test_split_heads_are_typed_whole(spark, tmp_path):
    heads = split_heads(spark, tmp_path)
    found = sorted(tuple(r) for r in catalog_grammar.split_heads_typed(spark, str(tmp_path)).collect())
    assert found == sorted((f"h/u{k}.{h[0]}", 2, h[6]) for k, h in heads if h[6] is not None)


def test_keys_below_zero_make_no_other_heads(spark, tmp_path):
    keys = [(k,) for k in (-9, -8, -2, -1, 3, None)]
    spark.createDataFrame(keys, "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    fuzzed, typed = (q(spark, str(tmp_path)).collect() for q in (catalog_grammar.split_heads_fuzzed, catalog_grammar.split_heads_typed))
    assert sorted(map(tuple, fuzzed)) == [("h/u-8.rs", 2, "parse_data", 66), ("h/u3.py", 2, "process", 56)]
    assert [tuple(r) for r in typed] == [("h/u3.py", 2, True)]
