"""Bounded samples keep their promises."""

from twinframe.llm.sampling import most_frequent


def frame(spark, counts):
    return spark.createDataFrame([(f"w{i}", n) for i, n in enumerate(counts)], "word string, n long")


def test_most_frequent_when_one_class_exceeds_the_bound(spark):
    got = most_frequent(frame(spark, [7] * 100 + [1] * 30), "n", 50).collect()
    assert 0 < len(got) <= 50 and {r.n for r in got} == {7}


def test_most_frequent_takes_whole_classes_from_the_top(spark):
    got = most_frequent(frame(spark, [1000, 500, 500, 40, 40, 40, 3]), "n", 5).collect()
    assert sorted(r.n for r in got) == [500, 500, 1000]
    assert most_frequent(frame(spark, [5, 4]), "n", 50).count() == 2 and most_frequent(frame(spark, []), "n", 5).count() == 0
