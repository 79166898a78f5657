"""Lines of few tokens, and of white space other than the blank, recur like others."""

from quillwork.llm import template_lines


def test_short_and_unsegmented_lines(spark):
    chinese = "这是一个在许多文件中重复出现的段落没有任何空格"
    shared = ["Home", "Contact us", "INFO\tserver\tstarted up", "INFO\u00a0the\u00a0service\u00a0stopped", chinese]
    rows = [(i, "\n".join([f"own{w}", *shared, "", f"{w} stays"])) for i, w in enumerate("alpha beta gamma delta epsilon zeta".split())]
    rows += [(20 + i, f"rare\nunique text number {w}") for i, w in enumerate("one two three four".split())]
    got = {r.doc_id: r.text for r in template_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own{w}\n\n{w} stays" for i, w in enumerate("alpha beta gamma delta epsilon zeta".split()) if i)
    assert all(got[20 + i].startswith("rare\n") for i in range(4))
