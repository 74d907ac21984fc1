"""Operator 12, ranked lexical search: Block-Max MaxScore over shards of compressed postings, whose heaps merge."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import cut, table

#: Postings of a block: what is decompressed at a time.
BLOCK = 128

#: Postings and documents of a shard at most, but for a single document with more; bounds a worker's memory and changes no result.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 16

#: Characters of query texts that one pass over the documents takes, on average; more queries take more passes.
PASS_CHARS = 1 << 22

#: Heaps of tasks merge in so many groups first.
MERGED = 64

_TERM = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c in _TERM else 32 for c in range(256))

INDEX = "doc_id long, n long, terms array<int>, tfs array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII digits, ASCII letters and characters beyond ASCII of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_SPLIT).split()


def forward_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """INDEX rows of the documents that hold a term: all their terms counted in ``n``, those of the vocabulary listed with their occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(vocabulary)}
        for batch in batches:
            at, sizes, ends, terms, tfs = [], [], [0], [], []
            for k, text in enumerate(batch.column(1)):
                found = terms_of(text.as_py())
                if found:
                    counts = Counter(found)
                    held = sorted((place[t], counts[t]) for t in counts.keys() & place.keys())
                    at.append(k)
                    sizes.append(len(found))
                    terms += [t for t, _ in held]
                    tfs += [n for _, n in held]
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(count, INDEX)


def _width(most: int) -> np.dtype:
    return np.dtype("u1") if most < 1 << 8 else np.dtype("u2") if most < 1 << 16 else np.dtype("u4") if most < 1 << 32 else np.dtype("u8")


class Shard:
    """Inverted lists of some documents. Lists are cut into blocks of gaps and occurrences, each as narrow as its largest value.

    ``impact`` of a posting is its score for a term of weight one. Of every
    block the first and last document and the largest impact are held beside
    the compressed bytes, of every list its largest impact.
    """

    def __init__(self, lengths: np.ndarray, owners: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """``lengths``: the m of each document; the postings come in the order of their documents."""
        self.lengths = lengths
        order = np.argsort(terms, kind="stable")
        terms, owners, tfs = terms[order], owners[order], tfs[order]
        impacts = self._impacts(owners, tfs)
        begins = np.flatnonzero(np.diff(terms, prepend=-1))
        ends = np.append(begins, len(terms))[1:]
        cuts = [np.arange(a, b, BLOCK) for a, b in zip(begins, ends)]
        starts = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
        stops = np.append(starts, len(terms))[1:]
        gaps = np.diff(owners, prepend=0)
        self.first, self.last = owners[starts], owners[stops - 1]
        self.most = np.maximum.reduceat(impacts, starts) if len(starts) else impacts
        gaps[starts] = 0
        wide = [np.maximum.reduceat(x, starts).tolist() if len(starts) else [] for x in (gaps, tfs)]
        self.blocks = [(b - a, (g := _width(p)), (t := _width(q)), gaps[a:b].astype(g).tobytes() + tfs[a:b].astype(t).tobytes()) for a, b, p, q in zip(starts.tolist(), stops.tolist(), *wide)]
        ranges = np.cumsum([0, *map(len, cuts)])
        top = np.maximum.reduceat(impacts, begins) if len(begins) else impacts
        self.lists = {int(terms[a]): (int(i), int(j), int(m)) for a, i, j, m in zip(begins, ranges, ranges[1:], top)}
        self.decompressed = 0

    def _impacts(self, owners: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tfs) // (1000 * tfs + 8 * self.lengths[owners])

    def decompress(self, which) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks of one list."""
        owners, tfs = [], []
        for b in which:
            n, gap, tf, data = self.blocks[b]
            owners.append(np.cumsum(np.frombuffer(data, gap, n), dtype=np.int64) + self.first[b])
            tfs.append(np.frombuffer(data, tf, n, n * gap.itemsize).astype(np.int64))
        self.decompressed += len(owners)
        owners = np.concatenate(owners)
        return owners, self._impacts(owners, np.concatenate(tfs))

    def search(self, query: dict[int, int], k: int, best: Best) -> None:
        """Puts the shard's documents that may be among the ``k`` best of a query (term: weight) into ``best``.

        Lists are ordered by their bounds. While the bounds of the first few
        together stay below the score to reach, these lists are not essential:
        no document comes in through them alone. Documents of the essential
        lists are scored window by window; a non-essential list is looked at
        only where its block's maximum could still lift a document to the score
        to reach, and only such blocks are decompressed. Equal scores are kept,
        so that ids decide.
        """
        held = sorted((w * self.lists[t][2], w, *self.lists[t][:2]) for t, w in query.items() if w > 0 and t in self.lists)
        bounds = np.cumsum([0, *(x[0] for x in held)])  # bounds[j]: of all lists before j
        low, size = 0, 4 * BLOCK
        while low < len(self.lengths):
            high, reach = min(low + size, len(self.lengths)), best.reach(k)
            essential = int(np.searchsorted(bounds[1:], reach))
            if essential == len(held):
                return
            spans = []
            for _, w, i, j in held:
                a = i + int(np.searchsorted(self.last[i:j], low))
                spans.append((a, max(a, i + int(np.searchsorted(self.first[i:j], high)))))
            tops = [w * int(self.most[a:b].max()) if b > a else 0 for (_, w, _, _), (a, b) in zip(held, spans)]
            if sum(tops) >= reach:
                score = np.zeros(high - low, np.int64)
                for (_, w, _, _), (a, b), top in zip(held[essential:], spans[essential:], tops[essential:]):
                    if top:
                        owners, impacts = self.decompress(range(a, b))
                        here = (owners >= low) & (owners < high)
                        score[owners[here] - low] += w * impacts[here]
                rest = np.minimum(bounds[: essential + 1], np.cumsum([0, *tops[:essential]]))
                found = np.flatnonzero((score > 0) & (score + rest[essential] >= reach))
                score = score[found]
                found = found + low
                for j in range(essential - 1, -1, -1):
                    if not len(found):
                        break
                    (_, w, i, e), (a, b) = held[j], spans[j]
                    block = a + np.searchsorted(self.last[a:b], found)
                    safe = np.minimum(block, e - 1)
                    there = (block < b) & (self.first[safe] <= found)
                    worth = there & (score + w * self.most[safe] + rest[j] >= reach)
                    score = score.copy()
                    if worth.any():
                        owners, impacts = self.decompress(np.unique(block[worth]).tolist())
                        at = np.minimum(np.searchsorted(owners, found), len(owners) - 1)
                        hit = worth & (owners[at] == found)
                        score[hit] += w * impacts[at[hit]]
                    keep = (worth | ~there) & (score + rest[j] >= reach)
                    found, score = found[keep], score[keep]
                best.add(score, found, k)
            low, size = high, 2 * size


class Best:
    """The best documents of one query so far; equal scores by ascending id, null ids last."""

    def __init__(self) -> None:
        self.scores, self.nulls, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.shard: tuple[np.ndarray, np.ndarray] = (self.nulls, self.ids)

    def reach(self, k: int) -> int:
        """The score a document needs at least."""
        return int(self.scores[-1]) if len(self.scores) == k else 1

    def add(self, scores: np.ndarray, found: np.ndarray, k: int) -> None:
        nulls, ids = self.shard
        scores, nulls, ids = (np.concatenate(x) for x in ((self.scores, scores), (self.nulls, nulls[found]), (self.ids, ids[found])))
        first = np.lexsort((ids, nulls, -scores))[:k]
        self.scores, self.nulls, self.ids = scores[first], nulls[first], ids[first]


def _shards(batches: Iterator[pa.RecordBatch], documents: int, occurrences: int) -> Iterator[tuple[np.ndarray, np.ndarray, Shard]]:
    """Shards of INDEX rows with their documents' (null id, id)."""
    kept: list[pa.RecordBatch] = []
    rows = postings = 0

    def built() -> tuple[np.ndarray, np.ndarray, Shard]:
        whole = pa.Table.from_batches(kept).combine_chunks()
        ids = whole["doc_id"].combine_chunks()
        lists = [whole[c].combine_chunks() for c in ("terms", "tfs")]
        sizes = np.diff(lists[0].offsets.to_numpy())
        lengths = 100 - 75 + (75 * whole["n"].to_numpy() * documents) // occurrences
        terms, tfs = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        shard = Shard(lengths, np.repeat(np.arange(len(sizes)), sizes), terms, tfs)
        return ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), shard

    for batch in batches:
        a = 0
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        while a < batch.num_rows:
            held = np.cumsum(sizes[a:]) + postings
            take = min(int(np.searchsorted(held, SHARD_POSTINGS, "right")), SHARD_DOCS - rows, batch.num_rows - a)
            take = max(take, int(not rows))
            if take:
                kept.append(batch.slice(a, take))
                rows, postings = rows + take, int(held[take - 1])
                a += take
            if a < batch.num_rows:
                yield built()
                kept.clear()
                rows = postings = 0
    if rows:
        yield built()


def _pass(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (item_id, rank, doc_id, score) of some (item_id, text) queries."""
    asked = [(i, Counter(terms_of(text))) for i, text in items]
    vocabulary = sorted(set().union(*(c for _, c in asked)))
    place = {t: k for k, t in enumerate(vocabulary)}
    index = cut(forward_index(docs, vocabulary, id_col, text_col))
    documents, occurrences = index.agg(F.count("*"), F.sum("n")).first()
    df = {r.t: r["count"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a number for each term of the pass
    weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    queries = [(i, {place[t]: c * weights[place[t]] for t, c in counts.items() if place[t] in weights}) for i, counts in asked]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in queries]
        for nulls, ids, shard in _shards(batches, documents, occurrences):
            for found, (_, query) in zip(best, queries):
                found.shard = nulls, ids
                shard.search(query, k, found)
        part = TaskContext.get().partitionId() % MERGED
        rows = [(at, i, part, None if null else int(d), int(s)) for at, ((i, _), b) in enumerate(zip(queries, best)) for null, d, s in zip(b.nulls, b.ids, b.scores)]
        if rows:
            kinds = {"at": pa.int32(), "item_id": pa.int64(), "part": pa.int32(), "doc_id": pa.int64(), "score": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds.values())], list(kinds))

    heaps = index.mapInArrow(search, "at int, item_id long, part int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["at", "part"], ["at"]):
        heaps = heaps.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return heaps.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """The ``k`` documents of highest score above 0 for every item: item_id, rank, doc_id, score; equal scores by ascending doc_id.

    Every document is indexed whole: its length, and its occurrences of the
    terms that the pass's items hold; the index is cut to the checkpoint folder.
    Document counts come from it, then each task builds shards of a bounded
    number of postings and searches them one after the other with one heap per
    item. Heaps merge in two steps, at most ``k`` rows of an item from a task.

    Items are taken in passes of about ``pass_chars`` characters, drawn by
    hash, so neither the driver nor a worker holds all of them. Null and empty
    texts have no terms: as documents they don't count, as items they have no
    rows. Null ids are ranked, last among equals. Repeated rows are documents,
    and items, of their own. Other columns are not read. Where either table is
    empty, so is the result.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(query_col), F.lit("")).alias("text"))
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // pass_chars))
    drawn = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    found = []
    for p in range(passes):
        rows = [(r.item_id, r.text.encode()) for r in asked.filter(drawn == p).collect()]
        if rows or not p:
            found.append(_pass(docs, rows, k, id_col, text_col))
    return reduce(DataFrame.union, found)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
               FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
asked AS (SELECT q, item_id, term, count(*) AS c
          FROM (SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)) GROUP BY ALL),
sizes AS (SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY d),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM sizes),
posts AS (SELECT d, term, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posts, whole GROUP BY term),
scored AS (SELECT a.q, any_value(a.item_id) AS item_id, any_value(s.doc_id) AS doc_id,
                  sum(a.c * g.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * s.n * whole.n_docs) // whole.l))))::BIGINT AS score
           FROM asked a JOIN posts p USING (term) JOIN weights g USING (term) JOIN sizes s ON s.d = p.d, whole GROUP BY a.q, p.d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
