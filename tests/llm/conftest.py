import pytest

CLASHING = ["keep_id", "block", "rep", "h", "n", "arc", "key", "label_id", "hit_id", "word", "packed", "stretch", "__kept", "range", "rank"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, lang), with columns whose names the operators use themselves."""
    def make(rows, parts=3):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else None, "src", len(r[1] or ""), *("x" for _ in CLASHING)) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space, ties, a repeated row, characters beyond the first plane, a long text."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two"), (6, "one two"), (6, "one two"), (7, "é😀 \x00\x01 ß"), (8, "a b c d e f g " * 30000), (9, "Aa. " * 5), (-3, "one two three four five six seven eight"), (10, "%%%")]
