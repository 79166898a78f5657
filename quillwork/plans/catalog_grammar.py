"""Registered queries over what a grammar reads: functions of a generated tree whose answers are known by construction.

Each part makes one file, in the language that its key picks; its names carry the key and its lines are moved down by
blank lines, so the rows that a file has to give are those of its sample, moved and renamed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, imports, metrics, parse, scans, surface
from ..sources import corpus
from .catalog import LINES, errors_of, parts, register, text
from .catalog_flows import HEAD as FLOW_HEAD
from .catalog_flows import tree

#: By extension: a file, and the (name, line, end line, complexity) of its functions, counted by hand. NN is the key.
SAMPLES = {
    "rs": (
        """impl Foo for Bar {
    // fn no() { if x {} }
    pub(crate) async fn goNN<'a>(&'a self,
        f: impl Fn(u8) -> u8) -> Vec<u8> where Self: Sized {
        let r = r#"fn fake() { if }"#; /* if /* nested */ for */
        for i in 0..3 { match i { 0 | 1 => {}, _ if i > 2 => (), _ => () } }
        let c = items.iter().map(|x| x + 1); let e = a | b; let z = a || b;
        println!("{}", if x { 1 } else { 2 });
        let Some(q) = y else { return };
        fn innerNN() { loop { while true {} } }
        if a { 'c' } else if b { '"' } else { '{' }
    }
    fn sigNN(&self);
}
""",
        (("goNN", 3, 12, 12), ("innerNN", 10, 10, 3)),
    ),
    "js": (
        """class ANN extends B {
  constructor(x) { super(x); }
  static async loadNN(u) { try { await f(u) } catch (e) { return a ? b : c?.d ?? e } }
}
const f = (a, b) => a + b;
const g = async x => {
  switch (x) { case 1: break; default: y() }
  do { z() } while (z);
  for (const k of q) { if (k) {} else if (j) {} else {} }
};
const o = { mNN(a) { return /if(x)/.test(a) ? 1 : 2 }, n: `a${b ? "if" : '}'}` };
function greetNN(name) { if (name) { return 'hi ' + name; } return 'hi'; }
""",
        (("constructor", 2, 2, 1), ("loadNN", 3, 3, 3), ("<anonymous>", 5, 5, 1), ("<anonymous>", 6, 10, 8), ("mNN", 11, 11, 2), ("greetNN", 12, 12, 2)),
    ),
    "ts": (
        """interface I { runNN(a: string): void; opt?: number }
type Fn = (a: number) => string;
export class CNN<T> {
  private x?: number;
  constructor(private readonly a: string, b?: number) {}
  public async getNN(id: string,
    cb: (e: Error) => void): Promise<T> { return id ? this.a : cb; }
}
export default function mainNN<T>(a: T): void { const h = (v: T): string => v + ''; }
""",
        (("runNN", 1, 1, 1), ("constructor", 5, 5, 1), ("getNN", 6, 7, 2), ("mainNN", 9, 9, 2), ("<anonymous>", 9, 9, 1)),
    ),
    "go": (
        """package main
func addNN(a, b int) int { return a + b }
func (s *Server) RunNN(x interface{}) (map[string]interface{}, error) {
	if x == nil { return nil, nil } else { y() }
	for i := range z { switch v := x.(type) { case int: a(); default: b() } }
	select { case <-ch: p(); case q <- 1: r(); default: s() }
	switch i { case 1: t() }
	return nil, `if {`
}
""",
        (("addNN", 2, 2, 1), ("RunNN", 3, 9, 7)),
    ),
    "c": ("#define M(a) if (a) { }\nstatic int addNN(int a, int b);\nint *twiceNN(int a,\n   int b) { if (a) { foo(b); } return a ? 1 : 2; }\n", (("addNN", 2, 2, 1), ("twiceNN", 3, 4, 1))),
    "cpp": (
        "namespace n { class ANN : public B { public: ANN(int x) : b(x) {} virtual void fNN() const override; };\nint ANN::g(\n  int y) { for (;;) {} return h(1); } }\n",
        (("ANN", 1, 1, 1), ("fNN", 1, 1, 1), ("ANN::g", 2, 3, 1)),
    ),
    "cs": (
        """class ANN {
  [Attr(1)]
  public ANN(int x) : base(x) { }
  public int FNN<T>(int? y) where T : class { switch (y) { case 1: case 2: return 1; default: return y > 3 ? 1 : 2; } }
  int GNN(int a) => a + 1;
  void HNN() { foreach (var q in z) { if (q) {} else {} } list.Where(x => x > 1); int LNN(int k) { return k; } var s = @"a""if"; }
}
""",
        (("ANN", 2, 3, 1), ("FNN", 4, 4, 5), ("GNN", 5, 5, 1), ("HNN", 6, 6, 4), ("LNN", 6, 6, 1)),
    ),
    "java": (
        """class ANN {
  @Override
  public int fNN(List<String> a) throws X { if (a) {} else if (b) {} for (int x : y) {} switch (z) { case 1: break; default: g(); } return a ? 1 : 2; }
  ANN() { this(1); list.forEach(x -> h(x)); }
  abstract void kNN();
}
""",
        (("fNN", 2, 3, 6), ("ANN", 4, 4, 2), ("kNN", 5, 5, 1)),
    ),
    "php": (
        "<html><?php\nfunction topNN($a) { if ($a) { } elseif ($b) { } else { } foreach ($x as $y) { } return $a ? 1 : 2; }\nclass KNN { public function m() { while (1) { switch ($q) { case 1: break; default: z(); } } } }\n",
        (("topNN", 2, 2, 5), ("KNN", 3, 3, 4)),
    ),
    "swift": (
        "protocol P { func q(a: Int) -> Int }\nclass A { static func rNN<T>(x: T) { guard let y = x else { return }\n repeat { z() } while k\n for i in 0..<3 { items.map { $0 + 1 } } } }\nfunc sNN(_ x: Int) -> String { if x > 0 { return \"if\" } else if x < 0 { return \"\" } }\n",
        (("rNN", 2, 4, 4), ("sNN", 5, 5, 3)),
    ),
    "kt": (
        "fun addNN(a: Int, b: Int): Int = a + b\nfun classifyNN(x: Int): String {\n  return when {\n    x > 0 -> \"if\"\n    else -> \"zero\"\n  }\n}\nclass A { override fun goNN(x: Int) { if (x > 1) { a() } else { b() }\n items.forEach { it + 1 }\n do { c() } while (d) } }\n",
        (("addNN", 1, 1, 1), ("classifyNN", 2, 7, 4), ("goNN", 8, 10, 5)),
    ),
    "sol": ("contract CNN { function fNN(uint a) public returns (uint) { if (a > 1) { return 1; } else { return 2; } }\n function gNN() external; modifier m() { _; } }\n", (("fNN", 1, 1, 3), ("gNN", 2, 2, 1))),
    "rb": (
        "class ANN\n  def self.goNN(x)\n    return 1 if x\n    while x do\n      y\n    end\n    [1].each do |z|\n      z unless z\n    end\n    begin\n      a\n    rescue E\n      b\n    end\n    if x then 1 elsif y then 2 else 3 end\n  end\nend\n",
        (("goNN", 2, 16, 5),),
    ),
    "py": (
        "class T:\n    @cached\n    def oneNN(self, x):\n        return [y for y in x if y] if x else (lambda: 1)\n\ndef twoNN(a,\n         b):\n    try:\n        with a:\n            pass\n    except E:\n        pass\n    if a:\n        pass\n    elif b:\n        pass\n",
        (("<anonymous>", 2, 4, 2), ("oneNN", 3, 4, 2), ("twoNN", 6, 16, 6)),
    ),
}
KINDS = tuple(SAMPLES)


def source_tree(spark, sf_dir):
    """(path, content): files of the samples, key by key, moved down by up to three lines."""
    k = F.col("p_partkey")
    kind = (k % len(KINDS)).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), kind + 1)
    down = F.repeat(F.lit("\n"), (k % 4).cast("int"))
    return parts(spark, sf_dir).select(F.concat(F.lit("src/f"), k.cast("string"), F.lit("."), pick(KINDS)).alias("path"), F.concat(down, F.replace(pick([s for s, _ in SAMPLES.values()]), F.lit("NN"), k.cast("string"))).alias("content"))


ROWS = ", ".join(f"({n}, '{ext}', {text(name)}, {line}, {end}, {c})" for n, (ext, (_, rows)) in enumerate(SAMPLES.items()) for name, line, end, c in rows)
LANGUAGE = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{corpus.LANGUAGES[e]}'" for e in KINDS) + " END"


@register("source_functions", f"""SELECT 'src/f' || p_partkey || '.' || ext AS path, replace(name, 'NN', p_partkey::VARCHAR) AS name, (line + p_partkey % 4)::INT AS line, (last + p_partkey % 4)::INT AS end_line, c AS complexity, {LANGUAGE} AS lang, false AS parse_error
    FROM part JOIN (VALUES {ROWS}) v(kind, ext, name, line, last, c) ON p_partkey % {len(KINDS)} = kind""")
def source_functions(spark, sf_dir):
    return parse.functions(corpus.with_language(source_tree(spark, sf_dir)))


@register("complex_functions", f"""WITH f AS (SELECT {LANGUAGE} AS lang, c FROM part JOIN (VALUES {ROWS}) v(kind, ext, name, line, last, c) ON p_partkey % {len(KINDS)} = kind)
    SELECT lang, count(*) AS n, sum(c)::BIGINT AS total, max(c) AS most, count(*) FILTER (c >= 10) AS violations FROM f GROUP BY lang""")
def complex_functions(spark, sf_dir):
    found = parse.functions(corpus.with_language(source_tree(spark, sf_dir)))
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("complexity").alias("total"), F.max("complexity").alias("most"), F.count(F.when(F.col("complexity") >= 10, 1)).alias("violations"))


# --- error handling in all its languages ----------------------------------------------------------

ERROR_LINES = (
    "x.unwrap();", "let _ = y.unwrap();", "let _ = z();", 'panic!("no");', "todo!()", "// a.unwrap()", "# b.unwrap()", "ok();", "except:", "except Exception:", "except Exception as e:", "except ValueError:", "pass", "",
    "f().catch(() => {})", "g().catch()", "h().catch(e => log(e))", "} catch (e) {", "}", "_ = f()", "_, _ = g()", "if err != nil {", "if err != nil { // why", "return err", "unreachable!()", "value.expect(reason)", "#[cfg(test)]", "mod tests {",
)
ERROR_COUNT, ERROR_STEP = 16, len(ERROR_LINES)
ERROR_FILES = f"""files AS (SELECT 'e/u' || p_partkey || '.' || ({list(scans.ERROR_EXTENSIONS)!r})[1 + p_partkey % {len(scans.ERROR_EXTENSIONS)}] AS path,
    array_to_string([([{', '.join(map(text, ERROR_LINES))}])[1 + (p_partkey // 6 * (j + 1) + j * j) % {ERROR_STEP}] FOR j IN range({ERROR_COUNT})], chr(10)) AS content FROM part)"""


@register("error_handling_languages", errors_of(f"WITH {ERROR_FILES}, {LINES}"))
def error_handling_languages(spark, sf_dir):
    p = F.col("p_partkey")
    table, ext = F.array(*map(F.lit, ERROR_LINES)), F.array(*map(F.lit, scans.ERROR_EXTENSIONS))
    lines = F.transform(F.sequence(F.lit(0), F.lit(ERROR_COUNT - 1)), lambda j: F.element_at(table, (F.pmod(F.floor(p / len(scans.ERROR_EXTENSIONS)) * (j + 1) + j * j, F.lit(ERROR_STEP)) + 1).cast("int")))
    name = F.concat(F.lit("e/u"), p.cast("string"), F.lit("."), F.element_at(ext, (F.pmod(p, F.lit(len(scans.ERROR_EXTENSIONS))) + 1).cast("int")))
    files = parts(spark, sf_dir).select(name.alias("path"), F.concat_ws("\n", lines).alias("content"))
    return scans.error_handling(corpus.lines(files, "after"))


# --- signatures over several lines ---------------------------------------------------------------

#: Heads whose parameters are cut apart by each file in its own way, and what they are worth: the score of the fuzz
#: surface, and whether they are typed (null where that isn't asked).
HEADS = (
    ("rs", "pub fn parse_data(", "data: &[u8],path: &str,limit: usize", ") -> Result<String> {", "parse_data", 66, None),
    ("rs", "fn plain(", "x: i32,y: i32", ") -> i32 {", "plain", None, None),
    ("rs", "async fn feed(", "body: Vec<u8>,f: impl Fn(u8, u8) -> u8", ") {", "feed", 31, None),
    ("py", "def process(", "self,data: bytes,name: str = 'a)'", ") -> str:", "process", 56, True),
    ("py", "async def untyped(", "self,items", "):", "untyped", None, False),
    ("ts", "function load(", "url: string,depth", "): void {", "load", 24, True),
    ("ts", "export async function bare(", "url,depth", ") {", "", None, None),
    ("go", "func Read(", "p []byte,s string", ") error {", "Read", 54, None),
)


def head_tree(spark, sf_dir):
    k = F.col("p_partkey")
    kind = (k % len(HEADS)).cast("int")
    pick = lambda n: F.get(F.array(*[F.lit(h[n]) for h in HEADS]), kind)  # noqa: E731  (no file for a remainder below 0)
    # after a comma the line may break, by the key
    listed = F.replace(pick(2), F.lit(","), F.when(k % 3 == 0, ", ").when(k % 3 == 1, ",\n    ").otherwise(",\n\n\t"))
    body = F.concat(F.lit("// head\n"), pick(1), F.when(k % 2 == 0, F.lit("\n    ")).otherwise(""), listed, F.when(k % 5 == 0, F.lit("\n")).otherwise(""), pick(3), F.lit("\n    body(string)\n}\n"))
    return parts(spark, sf_dir).select(F.concat(F.lit("h/u"), k.cast("string"), F.lit("."), pick(0)).alias("path"), body.alias("content"))


HEAD_ROWS = ", ".join(f"({n}, '{h[0]}', '{h[4]}', {h[5] or 'NULL'}, {'NULL' if h[6] is None else str(h[6]).lower()})" for n, h in enumerate(HEADS))
HEAD_OF = f"SELECT 'h/u' || p_partkey || '.' || ext AS file, name, score, typed FROM part JOIN (VALUES {HEAD_ROWS}) v(kind, ext, name, score, typed) ON p_partkey % {len(HEADS)} = kind"


@register("split_heads_fuzzed", f"WITH h AS ({HEAD_OF}) SELECT file, 2 AS line, name, score FROM h WHERE score IS NOT NULL")
def split_heads_fuzzed(spark, sf_dir):
    lines = surface.whole_heads(corpus.lines(head_tree(spark, sf_dir), "head"))
    return surface.fuzz_surface(lines, surface.harness_names(lines), spark.createDataFrame([], "file string, name string, line int, complexity int")).select("file", "line", "name", "score")


@register("split_heads_typed", f"WITH h AS ({HEAD_OF}) SELECT file, 2 AS line, typed FROM h WHERE typed IS NOT NULL")
def split_heads_typed(spark, sf_dir):
    lines = surface.whole_heads(corpus.lines(head_tree(spark, sf_dir), "above", "head"))
    return surface.typed_functions(lines).select("file", "line", "typed")


# --- documentation that is attached, modules from files -------------------------------------------

DOC_EVENT = "CASE WHEN (starts_with(trimmed, '///') AND NOT starts_with(trimmed, '////')) OR (starts_with(trimmed, '/**') AND NOT starts_with(trimmed, '/***')) OR starts_with(trimmed, '#[doc') THEN true WHEN trimmed = '' OR regexp_matches(trimmed, '^(#\\[|//|\\*|/\\*)') THEN NULL ELSE false END"


@register("attached_documentation", f"""{FLOW_HEAD}, d AS (SELECT path AS file, line, ext, regexp_extract(trimmed, '{surface.RUST_PUBLIC}', 1) AS kind, coalesce(last_value({DOC_EVENT} IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS documented FROM lines)
    SELECT file, line, kind, documented FROM d WHERE ext = 'rs' AND kind <> ''""")
def attached_documentation(spark, sf_dir):
    found = surface.attached_items(corpus.lines(tree(spark, sf_dir), "above", "after", "attached"))
    return found.filter(F.col("file").endswith(".rs"))


EDGES = rf"""{FLOW_HEAD}, i AS (SELECT DISTINCT path AS src, CASE WHEN ext = 'rs' AND starts_with(trimmed, 'use ') THEN trim(regexp_replace(trimmed[5:], ';+$', '')) WHEN ext = 'py' AND starts_with(trimmed, 'from ') THEN regexp_extract(trimmed, '^from (\S+) import ', 1)
        WHEN ext = 'py' AND starts_with(trimmed, 'import ') THEN regexp_extract(trimmed, '^import ([^\s,;]+)', 1) WHEN ext IN ('js', 'ts') AND starts_with(trimmed, 'import ') THEN regexp_extract(trimmed, '["'']([^"'']*)["'']', 1) WHEN ext = 'go' AND regexp_matches(trimmed, '^(?:import )?(?:\w+ )?"[^"]*"$') THEN regexp_extract(trimmed, '"([^"]*)"', 1) END AS dst, ext FROM lines),
    e AS (SELECT src, dst FROM i WHERE dst <> '' AND NOT ends_with(dst, '::*') AND (ext <> 'rs' OR regexp_matches(dst, '^(crate|self|super)::') OR NOT contains(dst, '::')))"""


@register("module_coupling", f"""{EDGES}, o AS (SELECT src AS module, count(*) AS fan_out FROM e GROUP BY 1), n AS (SELECT dst AS module, count(*) AS fan_in FROM e GROUP BY 1)
    SELECT module, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, round(coalesce(fan_out, 0) / (coalesce(fan_out, 0) + coalesce(fan_in, 0)), 6) AS instability FROM o FULL JOIN n USING (module)""")
def module_coupling(spark, sf_dir):
    return metrics.coupling(imports.module_graph(corpus.lines(tree(spark, sf_dir))))


@register("coupled_modules", f"""{EDGES}, m AS (SELECT src AS module FROM e UNION ALL SELECT dst FROM e) SELECT module, count(*) AS edges FROM m GROUP BY 1 HAVING count(*) >= 3""")
def coupled_modules(spark, sf_dir):
    found = imports.coupled(metrics.coupling(imports.module_graph(corpus.lines(tree(spark, sf_dir)))), least=3)
    return found.select("module", (F.col("fan_in") + F.col("fan_out")).alias("edges"))


@register("import_dot_graph", f"""{EDGES} SELECT 1 AS part, 0 AS ord, '  "' || string_split(src, '::')[-1] || '" -> "' || string_split(dst, '::')[-1] || '";' AS value FROM e
    UNION ALL VALUES (0, 0, 'digraph coupling {{'), (0, 1, '  rankdir=LR;'), (0, 2, '  node [shape=box, style=filled, fillcolor=lightblue];'), (0, 3, ''), (2, 0, ''), (2, 1, '}}')""")
def import_dot_graph(spark, sf_dir):
    return imports.dot_graph(imports.module_graph(corpus.lines(tree(spark, sf_dir))))


# --- shapes ---------------------------------------------------------------------------------------

#: By extension: the head of a function, and statements with the tokens that each one gives, put down by hand.
SHAPES = {
    "rs": ("fn f() {", (("if a { }", "IF BLOCK"), ("while b { }", "WHILE BLOCK"), ("let c = 1;", "LET"), ("d(1);", "CALL"), ("return;", "RET"), ("loop { }", "LOOP BLOCK"), ("for e in f { }", "FOR BLOCK"), ("match g { h => 1 }", "MATCH BLOCK ARM"))),
    "js": ("function f() {", (("if (a) { }", "IF BLOCK"), ("while (b) { }", "WHILE BLOCK"), ("let c = 1;", "LET"), ("d(1);", "CALL"), ("return;", "RET"), ("try { } catch (e) { }", "TRY BLOCK TRY BLOCK"), ("for (;;) { }", "FOR BLOCK"), ("x = 'if (y)';", ""))),
    "go": ("func f() {", (("if a { }", "IF BLOCK"), ("for b { }", "FOR BLOCK"), ("c := 1", "LET"), ("d(1)", "CALL"), ("return", "RET"), ("switch e { case 1: }", "MATCH BLOCK ARM"), ("if g { } else { }", "IF BLOCK ELSE BLOCK"), ("// for", ""))),
    "java": ("class T { void f() {", (("if (a) { }", "IF BLOCK"), ("while (b) { }", "WHILE BLOCK"), ("var c = 1;", "LET"), ("d(1);", "CALL"), ("return;", "RET"), ("x.map(y -> 1);", "CALL LAMBDA"), ("for (;;) { }", "FOR BLOCK"), ("if (g) { } else { }", "IF BLOCK ELSE BLOCK"))),
}
SHAPED = tuple(SHAPES)
PARTS = 8
TOKEN_LISTS = "[" + ", ".join("[" + ", ".join("[" + ", ".join(f"'{t}'" for t in tokens.split()) + "]::VARCHAR[]" for _, tokens in statements) + "]" for _, statements in SHAPES.values()) + "]"


def shape_tree(spark, sf_dir):
    k = F.col("p_partkey")
    kind = (k % len(SHAPED)).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), kind + 1)
    bits = F.floor(k / len(SHAPED)) % 255 + 1
    lines = [F.when(bits.bitwiseAND(1 << n) > 0, pick([statements[n][0] for _, statements in SHAPES.values()])) for n in range(PARTS)]
    body = F.concat_ws("\n", pick([head for head, _ in SHAPES.values()]), *lines, F.when(kind == SHAPED.index("java"), "} }").otherwise("}"))
    return parts(spark, sf_dir).select(F.concat(F.lit("d/"), k.cast("string"), F.lit("."), pick(SHAPED)).alias("path"), body.alias("content"))


ALIKE = "list_filter(g.seeds, lambda x: len(list_intersect(x.s, o.s)) / len(list_distinct(x.s || o.s)) >= 0.7)"


@register("duplicate_shapes", f"""WITH RECURSIVE k AS (SELECT p_partkey AS ord, flatten([CASE WHEN ((p_partkey // {len(SHAPED)}) % 255 + 1) & (1 << n) > 0 THEN ({TOKEN_LISTS})[1 + p_partkey % {len(SHAPED)}][n + 1] ELSE [] END FOR n IN range({PARTS})]) AS t FROM part),
    f AS (SELECT ord, list_sort(list_distinct(t)) AS s FROM k WHERE len(t) >= 5), d AS (SELECT s, min(ord) AS first FROM f GROUP BY s), o AS (SELECT *, row_number() OVER (ORDER BY first) AS n FROM d),
    g AS (SELECT 0::BIGINT AS n, []::STRUCT(seed BIGINT, s VARCHAR[])[] AS seeds, NULL::VARCHAR[] AS s, NULL::BIGINT AS grp
      UNION ALL SELECT o.n, CASE WHEN len({ALIKE}) > 0 THEN g.seeds ELSE list_append(g.seeds, {{'seed': o.first, 's': o.s}}) END, o.s, coalesce({ALIKE}[1].seed, o.first) FROM g JOIN o ON o.n = g.n + 1)
    SELECT f.ord, g.grp AS "group" FROM f JOIN g ON g.s = f.s""")
def duplicate_shapes(spark, sf_dir):
    prints = parse.fingerprints(corpus.with_language(shape_tree(spark, sf_dir)))
    return graphs.duplicate_groups(prints.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("ord"), "tokens"))
