from math import floor

import pytest

from envspark.llm.mixing import mix_rows, mixed


def water_fill(sizes, weights, share, most):
    """Targets by sharing out again and again."""
    left, open_, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def test_targets_and_taken_words(make_docs):
    sources = ["s0", "s1", "s2", "s3", None, "s5"]
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), sources[0 if i % 3 == 0 else i % 6]) for i in range(3000)]
    got = mixed(make_docs(rows)).select("source", "_mix.*").collect()
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    size = {s: sum(r.size for r in got if r.source == s) for s in names}
    wanted = water_fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for s, t in zip(names, wanted):
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(t) and mine[0].source_size == size[s]
        assert sum(r.taken for r in mine) == pytest.approx(t, rel=0.03, abs=100)
        rate = t / size[s]
        assert all(floor(rate) <= r.copies <= -(-rate // 1) for r in mine)


def test_rows_come_as_often_as_taken(odd_docs, clashing):
    docs = clashing(odd_docs, but=("_mix",))
    taken = {}
    for r in mixed(docs).select("doc_id", "_mix.copies").collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    rows = mix_rows(docs)
    assert rows.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v}


def test_reruns_agree(odd_docs):
    one, two = (sorted(map(tuple, mixed(d).select("doc_id", "_mix.taken").collect()), key=repr) for d in (odd_docs, odd_docs.repartition(7)))
    assert one == two
