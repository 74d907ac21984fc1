import numpy as np

from envspark.llm.chunk_dedup import _GEAR, LEAST, MOST, cuts, repeated_spans, rolling


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnoprstuvwé"), rng.integers(2, 9))) for _ in range(n))


def test_rolling_hash_is_the_gear_hash():
    data = np.random.default_rng(0).integers(0, 256, 200, dtype=np.uint8)
    h, wanted = 0, []
    for b in data:
        h = ((h << 1) + int(_GEAR[b])) & 0xFFFF
        wanted.append(h)
    assert rolling(data).tolist() == wanted


def test_chunks_cover_the_text_and_cut_between_characters():
    rng = np.random.default_rng(1)
    for text in (prose(rng, 500), "é" * 3000, "日本語" * 900, "x", "ab " * 2000, "\U0001f642" * 500):
        raw = text.encode()
        ends = cuts(np.frombuffer(raw, np.uint8))
        assert ends[-1] == len(raw) and ends == sorted(set(ends))
        sizes = np.diff([0, *ends])
        assert sizes.max() <= MOST and (sizes[:-1] >= LEAST - 3).all()
        assert "".join(raw[a:b].decode() for a, b in zip([0, *ends], ends)) == text


def test_cuts_do_not_depend_on_parts(monkeypatch):
    from envspark.llm import chunk_dedup

    data = np.frombuffer(prose(np.random.default_rng(2), 4000).encode(), np.uint8)
    whole = cuts(data)
    monkeypatch.setattr(chunk_dedup, "PART", 257)
    assert cuts(data) == whole


def test_repeated_passages_are_found_and_clean_texts_left(make_docs, clashing):
    rng = np.random.default_rng(3)
    passages = [prose(rng, 60) for _ in range(8)]
    rows = [(i, prose(rng, 120)) for i in range(40)]
    for g, p in enumerate(passages):
        for k in range(3):
            rows.append((100 + 10 * g + k, prose(rng, 30 + 7 * k) + "\n" + p + " " + prose(rng, 25)))
    docs = clashing(make_docs(rows + [(500, None), (501, ""), (None, passages[0]), (100, rows[40][1])]), but=("size",))
    got = repeated_spans(docs).collect()
    text = dict(rows)
    assert {r.doc_id for r in got} == {100 + 10 * g + k for g in range(8) for k in (1, 2)}
    for r in got:
        assert r.kept_in == r.doc_id // 10 * 10
        assert text[r.doc_id][r.start : r.end] in text[r.kept_in]
        assert r.words >= 26
    assert repeated_spans(docs.limit(0)).count() == 0


def test_a_passage_everyone_has_multiplies_nothing(make_docs):
    rng = np.random.default_rng(4)
    shared = prose(rng, 80)
    got = repeated_spans(make_docs([(i, prose(rng, 20) + " " + shared) for i in range(400)])).collect()
    assert len(got) == 399 and {r.kept_in for r in got} == {0}


def test_a_passage_repeated_inside_one_document_is_kept_once(make_docs):
    rng = np.random.default_rng(5)
    shared = prose(rng, 200) + "\n"
    rows = [(1, shared * 20), (2, prose(rng, 30) + " " + shared + prose(rng, 300) + " " + shared), (3, prose(rng, 400))]
    got = {}
    for r in repeated_spans(make_docs(rows)).collect():
        assert r.kept_in == 1
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert set(got) == {1, 2}
    assert len(shared) <= min(got[1])[0] < len(shared) + 2 * MOST and sum(b - a for a, b in got[1]) >= 18 * len(shared)
    assert len(got[2]) == 2
