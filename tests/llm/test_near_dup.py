import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from envspark.llm.common import connected
from envspark.llm.near_dup import COUNTED, ball_links, drop_near, fingerprints_of, near_components, shingle_hashes


def fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, radius):
    """Smallest key reachable over values at most ``radius`` bits apart, all pairs tried."""
    keys = sorted(values)
    low = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if low[b] < low[a] and (values[a] ^ values[b]).bit_count() <= radius:
                    low[a], changed = low[b], True
    return low


def test_hashes_are_those_of_the_engine(spark):
    text = "The quick  brown\tfox ÄB jumps"
    parts = spark.range(1).select(F.xxhash64(F.lit("the quick brown")), F.xxhash64(F.lit("fox Äb jumps"))).first()
    got = shingle_hashes(text, 3).view(np.int64)
    assert got[0] == parts[0] and got[-1] == parts[1] and len(got) == 4


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_ball_links_join_what_all_pairs_join(spark, radius):
    rng = np.random.default_rng(radius)
    bits = 16
    values = sorted({int(x) for x in rng.integers(0, 1 << bits, 90)} | {v ^ (1 << int(rng.integers(bits))) for v in range(3, 20)})
    links = ball_links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, bits).collect()
    assert all((r.u ^ r.v).bit_count() <= radius for r in links)
    roots = {r.node: r.root for r in connected(spark.createDataFrame([tuple(r) for r in links], "u long, v long")).collect()}
    wanted = components({v: v for v in values}, radius)
    assert {v: roots.get(v, v) for v in values} == wanted


def test_components_of_texts(spark, odd_docs, make_docs, clashing):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    base = " ".join(rng.choice(words, 400))
    rows = [(100 + i, base.replace("word7 ", f"other{i} ", 1) if i else base) for i in range(12)] + [(200 + i, " ".join(rng.choice(words, 60))) for i in range(20)]
    docs = clashing(odd_docs.unionByName(make_docs(rows)))
    got = near_components(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    prints = {k: fingerprint(t) for k, t in texts.items()}
    wanted = components(prints, 3)
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id == 1
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", wanted[r.doc_id])
    assert len(set(wanted.values())) < len(wanted)


def test_one_of_each_group_stays_and_clean_texts_stay(make_docs, clashing):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    rows, group = [], 0
    for g in range(12):
        base = rng.choice(words, 300)
        for k in range(4):
            text = base.copy()
            text[rng.integers(0, 300, k)] = "changed"
            rows.append((1000 * g + k, " ".join(text)))
    clean = [(90_000 + i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(6, 400, 60))]
    docs = clashing(make_docs(rows + clean))
    got = drop_near(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.select("doc_id").collect()}
    assert {i for i, _ in clean} <= kept
    assert kept - {i for i, _ in clean} == {1000 * g for g in range(12)}


def test_odd_rows_of_the_stage(odd_docs):
    kept = [r.doc_id for r in drop_near(odd_docs).select("doc_id").collect()]
    assert sorted(map(str, kept)) == ["1", "3", "6", "7", "8", "8", "9", "None"]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in connected(links).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def jaccard(a, b, words=5):
    sets = [{tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def family(rng, base, n, first, lengths):
    """Texts that share all but the last words with the base."""
    return [(first + i, " ".join([*base[: -int(m)], *(f"x{first + i}y{k}" for k in range(int(m)))])) for i, m in zip(range(n), lengths)]


def test_links_follow_the_shingles_on_either_side_of_the_limit(make_docs):
    rng = np.random.default_rng(5)
    rows, wanted = [], set()
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(304)]
        pair = [(10 * g, " ".join(base)), *family(rng, base, 1, 10 * g + 1, [(25, 33, 34, 45)[g % 4]])]
        rows += pair
        wanted |= {10 * g} | ({10 * g + 1} if jaccard(pair[0][1], pair[1][1]) < 0.8 else set())
    assert len(rows) - len(wanted) == 30
    kept = {r.doc_id for r in drop_near(make_docs(rows)).select("doc_id").collect()}
    assert kept == wanted


def test_templated_pages_stay(make_docs):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(304)]
    pages = family(rng, base, 120, 0, [54] * 120)
    copies = [(1000 + i, pages[i][1] + " tail") for i in range(20)]
    assert 0.68 < jaccard(pages[0][1], pages[1][1]) < 0.72
    kept = {r.doc_id for r in drop_near(make_docs(pages + copies)).select("doc_id").collect()}
    assert kept == {i for i, _ in pages}


def test_copies_link_though_the_hubs_of_their_keys_fail(make_docs):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(304)]
    pages = family(rng, base, 60, 0, [70] * 60)
    copies = [(1000 + i, " ".join(t.split()[15:])) for i, t in pages]
    assert jaccard(pages[0][1], pages[1][1]) < 0.65 and jaccard(pages[0][1], copies[0][1]) > 0.9
    docs = make_docs(pages + copies)
    for more in ({"bands": 4, "rows": 1, "longs": 1},):
        kept = {r.doc_id for r in drop_near(docs, **more).select("doc_id").collect()}
        assert kept == {i for i, _ in pages}


def test_rows_that_stay_keep_all_columns(odd_docs, clashing):
    docs = clashing(odd_docs)
    got = drop_near(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "6", "7", "8", "8", "9", "None"]
    assert all(r["_op10_id"] == "extra _op10_id" and r["_bits_of_ids"] == "extra _bits_of_ids" for r in rows)


def test_components_end_as_stars(spark):
    """A path, a star and a clique, by the smallest node each."""
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    clique = [(a, b) for a in range(200, 212) for b in range(200, a)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(path + star + clique + [(7, 7), (None, 3)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in range(200, 212)}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_variants_are_not_sent_through_the_driver(spark):
    """A value has up to a thousand variants, of which the planner knows nothing."""
    from envspark.llm.near_dup import ball_links

    plan = ball_links(spark.range(500).select(F.xxhash64("id").alias("fp")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_batch_that_ends_with_the_hashes_counted_at_a_time(spark, make_docs):
    """Nothing is left over for the batch's last fingerprints."""
    full = " ".join(f"w{i}" for i in range(8 * COUNTED + 2))
    docs = make_docs([(1, "a b c d"), (2, full)]).coalesce(1)
    assert {r.doc_id: r.fingerprint for r in near_components(docs).collect()} == {i: f"{fingerprint(t):016x}" for i, t in [(1, "a b c d"), (2, full)]}
    assert fingerprints_of([], 2).shape == (0, 2)


def test_pairs_in_a_family_of_templated_pages_grow_with_its_size(make_docs, monkeypatch):
    from envspark.llm import near_dup

    rng = np.random.default_rng(8)
    near, made, totals = near_dup._near_prints, [], []
    monkeypatch.setattr(near_dup, "_near_prints", lambda pairs, *rest: made.append(pairs.count()) or near(pairs, *rest))
    for n in (60, 180):
        made.clear()
        assert drop_near(make_docs(family(rng, [f"w{i}" for i in range(304)], n, 0, [54] * n))).count() == n
        totals.append(sum(made))
    assert totals[1] < 5 * totals[0]


@pytest.mark.parametrize("similarity", [0.5, 0.75, 0.8])
def test_pairs_within_reach_hold_all_that_are_alike(spark, similarity):
    from envspark.llm.near_dup import _reach, _within_reach

    rng = np.random.default_rng(9)
    bases = [rng.permutation(1000)[:n] for n in (4, 5, 12, 12, 30, 60)]
    sets, roots = {}, {}
    for i in range(120):
        base = bases[i % 6]
        own = 2000 + 100 * i + np.arange(rng.integers(0, len(base) // 2 + 1))
        sets[i] = {int(x) for x in [*base[rng.random(len(base)) > rng.choice([0, 0.05, 0.3])], *own]} or {-1}
        roots[i] = i - i % 3 if i % 5 else i
    reach = _reach(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, set array<long>"), spark.createDataFrame(list(roots.items()), "id long, root long"), similarity)
    still = spark.createDataFrame([(1, i, r, 0, 120) for i, r in roots.items()], "key long, id long, root long, main long, n long")
    met = _within_reach(still, still.select("key", still.id.alias("hub"), still.root.alias("hub_root")), reach, similarity)
    got = {(r.id, r.hub) for r in met.filter("root <> hub_root").collect()}
    apart = {(a, b) for a in sets for b in sets if roots[a] != roots[b]}
    wanted = {(a, b) for a, b in apart if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}
    assert wanted and wanted <= got and len(got) < len(apart) / 2
