import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from envspark.llm.toxicity import CALIBRATED, Hasher, calibrate, fit, score_toxicity, train_toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("ka", "lo", "mi", "nu", "ret", "sal")]
    bad = {"en": ["vilest", "grubby"], "fr": ["crapule", "fumier"]}
    rows, labels = [], []
    for i in range(900):
        lang = "en" if i % 3 else "fr"
        text = list(rng.choice(words, rng.integers(5, 80)))
        toxic = int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            text.insert(int(rng.integers(len(text))), str(rng.choice(bad[lang])) + str(rng.choice(["", ",", "!"])))
        rows.append((i, " ".join(text), lang, "s", 0))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = train_toxicity(docs, labels)
    rows = score_toxicity(docs, model).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("toxic", "_toxic.*").collect()
    assert len(rows) > 100
    assert np.mean([(r.score >= 0.5) == r.toxic for r in rows]) >= 0.95
    assert np.mean([r.flagged == bool(r.toxic) for r in rows]) >= 0.95


def test_held_out_labels_are_not_learnt(corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = train_toxicity(docs, labels), train_toxicity(docs, turned)
    assert (one.embedding == two.embedding).all() and one.thresholds == two.thresholds
    assert zlib.crc32(b"0") % 5 == [r[0] for r in docs.filter("doc_id = 0").select(F.crc32(F.lit("0")) % 5).collect()][0]


def test_odd_rows(corpus, odd_docs, clashing):
    model = train_toxicity(*corpus)
    docs = clashing(odd_docs.withColumn("lang", F.when(F.col("doc_id") == 1, None).otherwise("xx")), but=("_toxic",))
    got = score_toxicity(docs, model)
    assert got.columns == [*docs.columns, "_toxic"]
    rows = got.select("doc_id", "_toxic.*").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.threshold == 0.5 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_long_texts_are_read_to_their_end():
    hasher = Hasher()
    clean = [hasher(" ".join(f"quiet{i % 50}" for i in range(a, a + 40))) for a in range(60)]
    foul = [np.concatenate([x[:20], hasher("vilest"), x[20:]]) for x in clean[:30]]
    model = fit(clean + foul, np.array([0] * 60 + [1] * 30), epochs=6)
    long = np.concatenate([clean[i % 60] for i in range(4000)])
    assert model.scores([long])[0] < 0.5 < model.scores([np.concatenate([long, hasher("vilest")])])[0]


def test_one_kind_of_label_and_no_labels(corpus):
    docs, labels = corpus
    for some in (labels.filter("toxic = 0"), labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        scores = {r.score for r in score_toxicity(docs.limit(5), train_toxicity(docs, some)).select("_toxic.score").collect()}
        assert len(scores) == 1 and scores.pop() <= 0.5


def test_thresholds_part_the_classes():
    scores, y = np.concatenate([np.linspace(0, 0.2, 40), np.linspace(0.3, 0.9, 30)]), np.array([0] * 40 + [1] * 30)
    assert calibrate(scores, y, ["a"] * 70) == {"a": pytest.approx(0.25)}
    assert calibrate(scores, y, ["a"] * 35 + ["b"] * 35).keys() == {"b"} and calibrate(scores[:0], y[:0], []) == {}


def test_thresholds_come_from_rows_the_network_did_not_see(corpus):
    """Turned labels of the rows kept apart move thresholds and nothing of the network."""
    docs, labels = corpus
    apart = F.pmod(F.xxhash64("doc_id", F.lit("thresholds")), F.lit(CALIBRATED)) == 0
    one, two = train_toxicity(docs, labels), train_toxicity(docs, labels.withColumn("toxic", F.when(apart, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (one.embedding == two.embedding).all() and (one.out == two.out).all()
    assert one.thresholds and one.thresholds != two.thresholds


def test_repeated_ids_count_once(corpus):
    docs, labels = corpus
    one, two = train_toxicity(docs, labels), train_toxicity(docs.union(docs).union(docs), labels)
    assert (one.embedding == two.embedding).all() and one.thresholds == two.thresholds


def test_responses_match_loops():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1000, (23, 3)).astype(np.int32)
    model = fit([ids, ids[:5]], np.array([0, 1]), epochs=1)
    for width, kernel in model.filters.items():
        slow = np.zeros((len(ids), kernel.shape[2]))
        for at in range(len(ids)):
            for k in range(kernel.shape[2]):
                slow[at, k] = model.bias[width][k] + sum(model.embedding[row][e] * kernel[j, e, k] for j in range(width) if at + j < len(ids) for row in ids[at + j] for e in range(kernel.shape[1]))
        assert np.allclose(model.responses(ids, width), slow, atol=1e-4)


def test_thresholds_match_a_search():
    rng = np.random.default_rng(2)
    for _ in range(20):
        s, y = rng.integers(0, 30, 120) / 30, (rng.random(120) < 0.4).astype(int)
        cuts = {c: 2 * (y * (s >= c)).sum() / ((s >= c).sum() + y.sum()) for c in np.unique(s)}
        found = calibrate(s, y, ["a"] * 120)["a"]
        assert 2 * (y * (s >= found)).sum() / ((s >= found).sum() + y.sum()) == pytest.approx(max(cuts.values()))


def test_every_labelled_document_is_learnt_from(spark):
    """The only toxic documents come after more than ten thousand others, in the order of their id hashes."""
    docs = spark.range(15000).select(F.col("id").alias("doc_id"), F.concat(F.lit("quiet"), F.col("id") % 50, F.lit(" calm"), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"))
    late = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id").desc()).limit(400).select(F.col("doc_id").alias("late"))
    docs = docs.join(late, F.col("doc_id") == F.col("late"), "left").cache()
    docs = docs.withColumn("text", F.when(F.col("late").isNotNull(), F.concat("text", F.lit(" vilest"))).otherwise(F.col("text")))
    labels = docs.select("doc_id", F.col("late").isNotNull().cast("int").alias("toxic"))
    model = train_toxicity(docs.drop("late"), labels)
    clean, foul = model.scores([Hasher()("quiet1 calm2"), Hasher()("quiet1 vilest calm2")])
    assert clean < 0.1 and foul > 0.5 and model.thresholds.keys() == {"en"}


def test_thresholds_of_a_table_are_those_of_arrays(spark):
    from envspark.llm.toxicity import thresholds

    rng = np.random.default_rng(4)
    rows = [(str(rng.choice(["", "a", "b", "c"])), float(rng.integers(0, 200)) / 200, int(rng.random() < 0.3)) for _ in range(800)] + [("rare", 0.5, 1), ("full", 0.2, 0)]
    lang, scores, y = zip(*rows)
    assert thresholds(spark.createDataFrame(rows, "lang string, score double, toxic int")) == pytest.approx(calibrate(np.array(scores), np.array(y), list(lang)))


def test_words_are_hashed_as_one_by_one(monkeypatch):
    import xxhash

    from envspark.llm import toxicity
    from envspark.llm.toxicity import ROWS, STEM

    def row(w):
        h = xxhash.xxh64_intdigest(w)
        return h % (ROWS - 1) + 1, (h >> 32) % (ROWS - 1) + 1, xxhash.xxh64_intdigest(w[:STEM], 1) % (ROWS - 1) + 1 if len(w) > STEM else 0

    odd = ["", " \t\n", "One two,three ONE", "Äpfel\u2003und_Öl x²y 12ab34", "x" * 500 + " " + "ab-" * 300, "42 -- 7", "ſtraße\x1cİstanbul", "One two,three ONE"]
    for remembered in (1, 3, 50_000):
        monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
        hasher = Hasher()
        for text in odd + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)} again" for i in range(300)] + odd:
            assert hasher(text).tolist() == [list(row(w)) for w in toxicity._WORDS.findall(text.lower())]
        assert len(hasher.known) <= remembered


def test_shards_follow_the_labels_however_the_join_is_planned(spark, monkeypatch):
    from envspark.llm import toxicity
    from envspark.llm.toxicity import _labelled

    monkeypatch.setattr(toxicity, "SHARD", 100)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("calm words").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        assert _labelled(docs, labels).rdd.getNumPartitions() == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
