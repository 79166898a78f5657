"""Long lines recur from two texts on, shorter ones don't."""

from quillwork.llm import template_lines


def test_long_lines_of_two_texts(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))
    other = long.rsplit(" ", 1)[0] + " changed"
    shorter = long.rsplit(" ", 1)[0]
    rows = [(1, f"first text\n{long}\n{shorter}"), (2, f"second text\n{long}\n{shorter}"), (3, f"third text\n{other}")]
    got = {r.doc_id: r.text for r in template_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"second text\n{shorter}", 3: rows[2][1]}
