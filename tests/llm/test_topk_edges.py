import pytest

from orbweaver.llm import topk


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, [1, 2], "q", 5), (2, [3, 4], "c", 6), (2, [3, 4], "c", 6), (3, [0, 0], "c", 7), (4, [1], "c", 8)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, block string, score int")
    got = sorted(map(tuple, topk.top_k(df.filter("vec_id = 1"), df, k=3).collect()))
    assert got == [(1, 1, 2, 11), (1, 2, 2, 11), (1, 3, 3, 0)]


def test_products_past_64_bits_raise(spark):
    df = spark.createDataFrame([(1, [1 << 62]), (2, [4])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, df, k=1).collect()
