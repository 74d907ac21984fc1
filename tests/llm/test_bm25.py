import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from envspark.llm import bm25

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """(doc_id, text) rows ranked for (item_id, text) rows, document by document."""
    held = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n, total = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms():
    text = "Größe42_x-Y\x7fz É ß a\x00b\t\U0001f600"
    assert [t.decode() for t in bm25.terms_of(text.encode())] == words(text) == ["größe42", "x", "y", "z", "É ß", "a", "b", "\U0001f600"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, [1 / (1 + j) for j in range(60)], k=rng.randint(1, 40)))) for k in range(600)]
    docs += [(1000 + k, "W1 w2, w3!") for k in range(30)] + [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3"), (None, "w59 w59"), (-5, None), (-6, ""), (-7, " .\n"), (-8, "w0 " * 100_000 + "Ünïq"), (-9, "Ünïq w40")]
    rng.shuffle(docs)
    items = [(1, "w1 w2 w3 w3"), (1, "w1 w2 w3 w3"), (2, None), (3, ""), (4, "nowhere"), (None, "w59 W40"), (5, " ".join(vocabulary) * 3), (6, "w0"), (8, "ünïq ÜNÏQ Ünïq"), (9, "w30 w31 w0 w1")]
    items += [(10 + k, " ".join(rng.choices(vocabulary, k=12))) for k in range(20)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_matches_brute_force(odd, clashing, k):
    docs, items, docs_df, items_df = odd
    assert found(bm25.ranked_search(clashing(docs_df), clashing(items_df), k)) == brute(docs, items, k)


def test_many_shards_blocks_and_passes(odd, monkeypatch):
    docs, items, docs_df, items_df = odd
    ranked = bm25.ranked_search(docs_df.coalesce(3), items_df, pass_chars=300)
    assert found(ranked) == brute(docs, items)


def test_shards_are_bounded_and_whole():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lists = [sorted(set(rng.integers(0, 50, rng.integers(0, 30)).tolist())) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([len(x) + 1 for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array([[1] * len(x) for x in lists], pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    before = bm25.SHARD_POSTINGS, bm25.SHARD_DOCS
    try:
        bm25.SHARD_POSTINGS, bm25.SHARD_DOCS = 100, 7
        shards = list(bm25._shards(iter([batch.slice(0, 200), batch.slice(200)]), 500, 9000))
    finally:
        bm25.SHARD_POSTINGS, bm25.SHARD_DOCS = before
    assert np.concatenate([ids for _, ids, _ in shards]).tolist() == list(range(500)) and max(len(ids) for _, ids, _ in shards) <= 7
    at = 0
    for _, ids, shard in shards:
        postings = {t: (shard.decompress(range(i, j))[0] + at).tolist() for t, (i, j, _) in shard.lists.items()}
        assert postings == {t: [d for d in range(at, at + len(ids)) if t in lists[d]] for t in {t for d in range(at, at + len(ids)) for t in lists[d]}}
        at += len(ids)


def test_blocks_are_rejected_before_they_are_decompressed():
    """A frequent term beside a rare one: few of its blocks are read."""
    n = 40_000
    owners = np.concatenate([np.arange(n), np.arange(0, n, 4001)])
    terms = np.concatenate([np.zeros(n, np.int32), np.ones(10, np.int32)])
    order = np.argsort(owners, kind="stable")
    tfs = np.concatenate([np.where(np.arange(n) < 300, 9, 1), np.full(10, 5)]).astype(np.int64)
    shard = bm25.Shard(np.full(n, 100), owners[order], terms[order], tfs[order])
    best = bm25.Best()
    best.shard = np.zeros(n, bool), np.arange(n)
    shard.search({0: 100, 1: 5000}, 2, best)
    assert shard.decompressed < 90 < len(shard.blocks) / 3
    scores = 100 * shard._impacts(np.arange(n), np.where(np.arange(n) < 300, 9, 1))
    scores[::4001] += 5000 * shard._impacts(np.arange(0, n, 4001), np.full(10, 5))
    expected = np.lexsort((np.arange(n), -scores))[:2]
    assert best.ids.tolist() == expected.tolist() and best.scores.tolist() == scores[expected].tolist()


def test_empty_tables(odd):
    _, _, docs, items = odd
    assert bm25.ranked_search(docs.limit(0), items).collect() == [] and bm25.ranked_search(docs, items.limit(0)).collect() == []
