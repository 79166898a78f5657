"""Error handling outside Rust."""

from quillwork.operators import scans
from quillwork.sources import corpus


def test_error_handling_of_other_languages(spark):
    files = {
        "a.py": "try:\n    f()\nexcept:\n    pass\nexcept Exception as e:\n    log(e)\n# except:\nexcept Exception:",
        "b.js": "f().catch(() => {})\ntry {\n} catch (e) {\n}\n// g().catch()\ng().catch()\n} catch (e) {\n  log(e)\n}",
        "c.tsx": "h().catch(e => log(e))\n} catch (e) {\n}",
        "d.go": "_ = f()\n_, _ = g()\nif err != nil {\n}\nif err != nil {\n\treturn err\n}",
        "e.rs": "x.unwrap();\nexcept:",
        "f.java": "_ = f()",
        "g.ts": "mod tests\nf().catch()",
    }
    lines = corpus.lines(spark.createDataFrame(list(files.items()), "path string, content string"))
    got = sorted((r.file, r.line, r.rule_id, r.severity) for r in scans.error_handling(lines).collect())
    assert got == [
        ("a.py", 3, "bare_except", "high"), ("a.py", 8, "bare_except", "high"), ("b.js", 1, "empty_catch", "medium"), ("b.js", 3, "empty_catch", "high"),
        ("b.js", 6, "empty_catch", "medium"), ("c.tsx", 2, "empty_catch", "high"), ("d.go", 1, "discard", "medium"), ("d.go", 2, "discard", "medium"),
        ("d.go", 3, "empty_error_handler", "high"), ("e.rs", 1, "unwrap", "medium"),
    ]
