"""Queries with a SQL twin, on the driver's tables and on tables of odd rows."""

import pytest
from oracle import compare, connect

from pyspark.sql import functions as F

from envspark.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name]) is None


TABLES = ("documents", "pages", "benchmark", "embeddings")


@pytest.fixture(scope="module")
def odd_dir(spark, odd_docs, clashing, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    clashing(odd_docs).write.parquet(f"{folder}/documents.parquet")
    urls = [(1, "http://A.Example.ORG/es/x?q"), (2, "ftp://example.org/en/12#a"), (3, None), (4, "no scheme"), (5, "http://x.com"), (6, "http://x.com/fr/a://b/de/"), (6, "http://x.com/fr/a://b/de/"), (None, "://org/"), (7, "http://notexample.org/es/"), (8, "http://com/de/"), (9, "")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("html", F.expr("case when page_id % 3 = 0 then repeat('<p>', 40) when page_id % 3 = 1 then url end"))
    clashing(pages).write.parquet(f"{folder}/pages.parquet")
    items = [(1, "one TWO three"), (1, "one TWO three"), (2, None), (None, "w7 w59999"), (3, "öl x")]
    clashing(spark.createDataFrame(items, "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(k, k % 3 if k % 5 else None, [((k * j) % 7 - 3) / 10 for j in range(16)]) for k in range(40)] + [(50, 1, None), (51, None, [0.1] * 15 + [None]), (52, None, [float("nan")] * 16)]
    clashing(spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>")).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op4_source_mix", "op5_licence_scan", "op7_url_rules", "op11_vector_codes", "op12_ranked_search", "op13_warc"])
def test_odd_rows_match_sql(spark, odd_dir, name):
    assert compare(spark, _connect(odd_dir), odd_dir, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op4_source_mix", "op5_licence_scan", "op7_url_rules", "op8_chunk_dedup", "op9_best_fit_packing", "op10_simhash_near_dedup", "op11_vector_codes", "op12_ranked_search", "op13_warc"])
def test_empty_tables(spark, empty_dir, name):
    df = QUERIES[name](spark, empty_dir)
    assert df.columns and df.count() == 0
