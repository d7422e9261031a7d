"""What stages of the pipeline write and shuffle: texts once in line dedup, not at all at the end of near-dedup."""

from pyspark.sql import functions as F

from flowjobs.llm import lines, near_dups
from flowjobs.llm.tables import read

SF = "/root/testdata/sf0.001"


def test_line_dedup_writes_each_text_once(spark, monkeypatch):
    written = []

    def kept(df, *args, own=lines.numbered):
        written.append(df)
        return own(df, *args)

    monkeypatch.setattr(lines, "numbered", kept)
    docs = read(spark, SF, "documents")
    out = lines.without_repeated_lines(docs)
    assert [f.name for df in written for f in df.schema if "text" in f.simpleString()] == ["text"]
    assert out.schema.names == docs.schema.names and out.count() == docs.count()


def test_columns_come_back_under_their_own_names(make):
    docs = make([(1, "the first line here\nsame line in both"), (2, "Same line in both\nand another line"), (3, None)]).withColumnRenamed("text", "Text")
    out = lines.dedup_lines(docs.withColumn("n_lines", F.lit("mine")))
    assert out.columns == [*docs.columns, "_n_lines", "n_lines", "n_dropped", "kept_text"]
    got = {r["doc_id"]: (r["Text"], r["_n_lines"], r["key"], r["n_dropped"], r["kept_text"]) for r in out.collect()}
    assert got == {1: ("the first line here\nsame line in both", "mine", "clash", 0, "the first line here\nsame line in both"), 2: ("Same line in both\nand another line", "mine", "clash", 1, "and another line"), 3: (None, "mine", "clash", 0, "")}


def test_near_dedup_shuffles_no_text_for_the_rows_that_stay(spark, monkeypatch):
    docs = read(spark, SF, "documents")
    rows = lambda df: sorted(map(str, df.collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = near_dups.keep_one(docs)
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        got = rows(out)
        monkeypatch.setattr(near_dups, "TRAVEL", 0)
        out = near_dups.keep_one(docs)
        assert "Exchange hashpartitioning" in out._jdf.queryExecution().executedPlan().toString()
        assert rows(out) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
