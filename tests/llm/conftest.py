import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from flowjobs.llm.tables import ship

    ship(spark)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns that clash with inner names."""

    def build(rows, schema="doc_id long, text string, source string"):
        rows = [tuple(r) + (None,) * (3 - len(r)) for r in rows]
        df = spark.createDataFrame(rows, schema)
        for c in ("rowkey", "node", "n", "key", "line", "pos", "size", "copies", "row", "score", "words", "component", "id", "value"):
            df = df.selectExpr("*", f"'clash' as {c}")
        return df

    return build
