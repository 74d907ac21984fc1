"""Operator 9, best-fit packing: best-two-fit over the histogram of piece lengths, places handed out by rank."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import cut, lean, modest_batches, table

#: Ends every document.
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 for itself, others from 256 up."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load_encoding(path: str):
    """The byte-level BPE of a tokenizer file, run by the faster of the two libraries that give its ids.

    Merging pairs by the smallest id of their join gives what the file's list of
    merges gives, as ids follow that list; tests hold both against each other.
    Strings of special tokens are ordinary text.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    special = {x["content"] for x in kept["added_tokens"]}
    if kept["model"]["type"] != "BPE" or kept["pre_tokenizer"]["type"] != "ByteLevel" or kept["pre_tokenizer"]["add_prefix_space"] or kept["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in kept["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def text_ids(text: str, path: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit bytes."""
    try:
        ids = load_encoding(path).encode_to_numpy(text, disallowed_special=())
    except ValueError:  # some hundred thousand blanks in a row overrun its pattern's stack
        ids = np.array(_load_tokenizer(path).encode(text, add_special_tokens=False).ids)
    return ids.astype("<u4").tobytes()


def cut_lengths(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, the first piece taking what is left over."""
    head = total % size
    starts = ([0] if head else []) + list(range(head, total, size))
    return [(a, size if a or not head else head) for a in starts]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Whole texts are encoded; null is empty."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["_id"], pdf["_text"]):
                ids = text_ids(text, path) + end
                for k, (a, n) in enumerate(cut_lengths(len(ids) // 4, size)):
                    rows.append((doc, k, a, n, zlib.crc32(memoryview(ids)[4 * a : 4 * (a + n)])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array([None if x is None else int(x) for x in out["doc_id"]], "Int64")
            yield out

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInPandas(lean(encode), PIECES)


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit on a histogram of lengths: (lengths of one bin in order, how many such bins).

    A bin is filled greedily, each time with the longest piece that fits. Then
    its smallest piece is swapped for the two unpacked pieces that fit the gap,
    opened by taking it out, more tightly than it did. A bin's pattern is
    repeated while its lengths last, so the work follows the number of
    different lengths, at most ``size``, and not the number of pieces.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    bins = []
    while left.any():
        free = left.copy()
        pattern, room = [], size
        while room:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            pattern.append(n)
            free[n] -= 1
            room -= n
        if room and len(pattern) > 1:
            gap = room + pattern[-1]
            have = np.flatnonzero(free[:gap])
            best = (pattern[-1], None)
            for a in have[::-1]:
                b = have[have <= min(a, gap - a)]
                if len(b) and b[-1] == a and free[a] < 2:
                    b = b[:-1]
                if len(b) and a + b[-1] > best[0]:
                    best = (int(a + b[-1]), (int(a), int(b[-1])))
                    if best[0] == gap:
                        break
            if best[1]:
                pattern[-1:] = best[1]
        need = np.bincount(pattern, minlength=size + 1)
        used = need > 0
        times = int((left[used] // need[used]).min())
        left -= times * need
        bins.append((tuple(pattern), times))
    return bins


def _places(bins: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple]:
    """By length, sorted by first rank: (first rank, pieces of this length in a bin, first sequence, offsets)."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in pattern:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, places in offsets.items():
            out.setdefault(n, []).append((ranks.get(n, 0), sequence, np.array(places)))
            ranks[n] = ranks.get(n, 0) + times * len(places)
        sequence += times
    return {n: (np.array([x[0] for x in rows]), [x[1] for x in rows], [x[2] for x in rows]) for n, rows in out.items()}


def pack(pieces: DataFrame, size: int = 1024, cells: int = 256) -> DataFrame:
    """Pieces with sequence_id and offset: every sequence gapless from 0 and at most ``size`` long.

    What meets in one place is the histogram of lengths, at most ``size`` rows,
    from which the bins are planned. Pieces of one length are interchangeable:
    each has a rank among them (a prefix sum over ``cells`` hash cells plus a
    rank inside its cell) and takes the place of that rank. A length that holds
    a third of all pieces is spread over its cells.
    """
    with modest_batches(pieces.sparkSession):
        pieces = cut(pieces)
    keyed = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    counts = cut(keyed.groupBy("length", "_cell").agg(F.count("*").alias("_n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most ``size`` rows
    places = _places(plan_bins(histogram, size), size)
    base = counts.select("length", "_cell", (F.sum("_n").over(W.partitionBy("length").orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(W.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("_in", inside).join(base, ["length", "_cell"]).withColumn("_rank", F.col("_base") + F.col("_in"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            for n in np.unique(lengths):
                firsts, begins, offsets = places[int(n)]
                rows = np.flatnonzero(lengths == n)
                at = np.searchsorted(firsts, ranks[rows], "right") - 1
                for k in np.unique(at):
                    some = rows[at == k]
                    q, m = np.divmod(ranks[some] - firsts[k], len(offsets[k]))
                    sequence[some], offset[some] = begins[k] + q, offsets[k][m]
            yield pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(lean(place), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = 1024, **columns) -> DataFrame:
    """Documents tokenised, ended, cut and packed: one row per piece.

    A null or empty text is one piece holding the end id. Repeated rows are
    packed each, null ids come back null, other columns are not read, and an
    empty table gives an empty result. A document longer than a sequence has
    whole sequences but for its first piece, which takes the remainder.
    """
    return pack(token_pieces(docs, tokenizer, size, **columns), size)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
