"""Lines of documents: words are counted without splitting each line."""

from angula.llm import lines


def test_lines_are_masked_and_counted(spark):
    text = "  a b  c\td 5x \n\na b c\n x1y z-9 q w e \r\none two three four"
    out = lines.lines_of(spark.createDataFrame([(text,), (None,)], "text string"), "text")
    assert "split(line" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.nth, r.tokens, r.line) for r in out.collect())
    assert got == [(0, 5, "a b c d <*>"), (3, 5, "<*> <*> q w e"), (4, 4, "one two three four")]
