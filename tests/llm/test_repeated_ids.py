"""Top-k search where ids repeat, against its SQL."""

from collections import Counter

import duckdb
import numpy as np

from twinframe.llm import queries, topk_search


def test_rows_that_repeat_an_id_are_all_candidates_and_queries(spark):
    rng = np.random.default_rng(12)
    data = [(i % 150, rng.normal(0, 0.1, 8).tolist()) for i in range(260)]
    data += [(7, data[7][1])] * 2 + [(100, rng.normal(0, 0.1, 8).tolist())]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", data)
    want = Counter(con.sql(queries.TOP_K_SQL).fetchall())
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for shard in (8192, 30):
        assert Counter(map(tuple, topk_search.top_k(df, shard=shard).collect())) == want
