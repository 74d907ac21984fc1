import corpus_pipeline
import pytest

from envspark.llm.exact_dedup import normalised
from envspark.llm.mixing import mixed


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], sf_dir).write.parquet(f"{folder}/{k}")
        docs.append(spark.read.parquet(f"{folder}/{k}"))
    return docs


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages_keep_the_columns_of_documents(stages):
    assert all(d.dtypes == stages[0].dtypes for d in stages[:-1])


def test_every_stage_takes_effect(spark, sf_dir, stages):
    start, clean, distinct, apart, mix, pieces = stages
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = set(ids(start)) - set(ids(clean))
    assert gone and sum(labels.get(i, 1) for i in gone) >= 0.8 * len(gone)
    lowest = {}
    for r in clean.select("doc_id", normalised(clean.text).alias("t")).collect():
        lowest[r.t] = min(lowest.get(r.t, r.doc_id), r.doc_id)
    assert sorted(ids(distinct)) == sorted(lowest.values())
    assert set(ids(apart)) < set(ids(distinct)) and len(ids(apart)) == len(set(ids(apart)))
    assert len(ids(apart)) >= 0.9 * len(ids(distinct))
    taken = {r.doc_id: r.copies for r in mixed(apart).select("doc_id", "_mix.copies").collect()}
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    rows = pieces.collect()
    assert sum(r.piece == 0 for r in rows) == sum(counts.values())
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in places.values():
        ends = [a + n for a, n in sorted(spots)]
        assert [a for a, _ in sorted(spots)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


def test_no_documents(spark, sf_dir, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
