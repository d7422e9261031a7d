"""Sets are fetched alike whether the texts' numbers travel or are joined by a shuffle."""

from flowjobs.llm import near_dups
from flowjobs.llm.tables import read


def test_numbers_that_travel_and_numbers_that_do_not(spark, monkeypatch):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(map(tuple, near_dups.near_duplicates(docs).collect()))
    monkeypatch.setattr(near_dups, "TRAVEL", 0)
    assert sorted(map(tuple, near_dups.near_duplicates(docs).collect())) == got
