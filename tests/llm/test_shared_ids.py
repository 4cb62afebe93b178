"""Rows that share a doc_id and are not alike are all kept, each time the same."""

from plexloom.llm import near_dedup

A, B, C = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")


def test_keep_one(spark):
    rows = [(1, A), (1, B), (2, B + " more"), (3, C), (5, C), (5, A + " x"), (5, "only here and nowhere else at all"), (6, None), (6, ""), (None, A), (7, "some words"), (7, "some words"), (8, A + " y"), (8, A)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, A), (1, B), (3, C), (5, "only here and nowhere else at all"), (6, None), (7, "some words"), (None, A)]
    for parts in (1, 5):
        assert sorted(map(tuple, near_dedup.keep_one(docs.repartition(parts)).collect()), key=str) == sorted(want, key=str)


def test_one_of_alike_rows(spark):
    """Rows of one id that are linked with each other leave one row."""
    docs = spark.createDataFrame([(1, A + " x"), (1, A), (1, A + " y")], "doc_id long, text string")
    got = [[r.text for r in near_dedup.keep_one(docs.repartition(n)).collect()] for n in (1, 3)]
    assert len(got[0]) == 1 and got[0] == got[1]
