import zlib
from functools import lru_cache

import numpy as np
import pytest

from envspark.llm.packing import cut_lengths, default_tokenizer, pack_documents, plan_bins, text_ids


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t


def whole_ids(text):
    return [*tokenizer().encode(text, add_special_tokens=False).ids, 2]


TEXTS = ["", " ", "a", "a  b", " a b ", "a\n b", "a \nb", "it's don't 12ab  <|endoftext|> x", "é\u00a0 b\u2003 c", "a\t b c\r\n\r\n d", "end ", "   ", "'s 's a's", "x " * 50, "a  \n  b   c d", "日本 語 text\u200b z", "\x1c a \x1f b", "\x85 a b"]


def test_ids_are_those_of_the_tokenizer_file():
    rng = np.random.default_rng(3)
    alphabet = [" ", " ", " ", "\n", "\t", "a", "B", "é", "1", "'s", "<|endoftext|>", "!", "\u00a0", "\u3000", "word", "\x85", "\x1c"]
    for text in TEXTS + ["".join(rng.choice(alphabet, 40)) for _ in range(1500)]:
        assert [*np.frombuffer(text_ids(text, default_tokenizer()), "<u4").tolist(), 2] == whole_ids(text), repr(text)


def test_long_blanks_are_encoded():
    text = "a" + " " * 600_000 + "b"
    assert [*np.frombuffer(text_ids(text, default_tokenizer()), "<u4").tolist(), 2] == whole_ids(text)


def test_cut_lengths():
    assert cut_lengths(1, 4) == [(0, 1)] and cut_lengths(8, 4) == [(0, 4), (4, 4)] and cut_lengths(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_bins_hold_every_piece_once_and_are_few():
    rng = np.random.default_rng(5)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 1025), 400, replace=False), rng.integers(1, 2000, 400))}
    used, bins = {}, 0
    for pattern, times in plan_bins(counts, 1024):
        assert sum(pattern) <= 1024 and times > 0
        bins += times
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == counts
    assert bins <= 1.02 * sum(n * c for n, c in counts.items()) / 1024 + 2


def test_two_documents_replace_the_smallest():
    assert plan_bins({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]


def check(pieces, texts):
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    mine = {}
    for r in pieces:
        mine.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = whole_ids(text or "")
        rows = sorted(mine[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in rows] == [(k, a, n) for k, (a, n) in enumerate(cut_lengths(len(ids), 1024))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in rows)


def test_documents_round_trip(odd_docs, clashing):
    docs = clashing(odd_docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = pack_documents(docs.dropDuplicates(["doc_id"])).collect()
    check(pieces, texts)


def test_repeated_rows_have_places_of_their_own(make_docs):
    pieces = pack_documents(make_docs([(1, "a b c " * 700)] * 3 + [(2, "x")] * 900)).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    assert len({r.sequence_id for r in pieces}) == pytest.approx(sum(r.length for r in pieces) / 1024, abs=2)
