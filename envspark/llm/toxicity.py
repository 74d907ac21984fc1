"""Operator 6, toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on shards and averaged."""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import cut, lean, modest_batches, sheltered, sieve, table
from envspark.operators.slices import POS, running_sum

#: Embedding rows (row 0 stays zero), their size, filter widths, and filters of each width.
ROWS, SIZE, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 16

#: Labelled documents of a shard, about, and passes over all of them. Shards learn apart and are averaged after a pass.
SHARD, EPOCHS = 10_000, 3

#: Documents of a gradient step; steps of the whole numbers in which weights are added up, so that the order adds nothing.
BATCH, GRAIN = 32, float(1 << 32)

#: Of the labelled documents one in so many, by id hash, is kept from the network and sets the thresholds.
CALIBRATED = 5

#: Documents of the general rate that every word is taken to have been seen in beforehand.
PRIOR = 40

#: Letters that a longer word's stem row stands for.
STEM = 5

#: Learning rates of the output layer, the filters and the embedding.
OUT_RATE, FILTER_RATE, WORD_RATE = 0.05, 0.02, 0.01

#: Words scored at a time, and words a worker remembers; neither changes a result.
SCORED, REMEMBERED = 1 << 15, 50_000

_WORDS = re.compile(r"[^\W\d_]+")
_APART = {k: " " for k in range(128) if not chr(k).isalpha()}


def _rows_of(word: str) -> tuple[int, int, int]:
    h = xxhash.xxh64_intdigest(word)
    stem = xxhash.xxh64_intdigest(word[:STEM], 1) % (ROWS - 1) + 1 if len(word) > STEM else 0
    return h % (ROWS - 1) + 1, (h >> 32) % (ROWS - 1) + 1, stem


class Hasher:
    """Three embedding rows per word: two of the word, so that it shares both with another almost never, and one of its first letters."""

    def __init__(self):
        self.known: dict[str, int] = {}  # a word's place among the rows
        self.rows = np.zeros((REMEMBERED, 3), np.int32)

    def __call__(self, text: str) -> np.ndarray:
        text = text.lower()
        words = text.translate(_APART).split() if text.isascii() else _WORDS.findall(text)
        places = [*map(self.known.get, words)]
        if None not in places:
            return self.rows[np.array(places, np.int64)]
        # frequent words come early; what comes when all places are taken is hashed again in each text
        new: dict[str, int] = {}
        for w, k in zip(words, places):
            if k is None and w not in new:
                new[w] = REMEMBERED + len(new)
        found = np.array([_rows_of(w) for w in new], np.int32)
        at, free = len(self.known), max(REMEMBERED - len(self.known), 0)
        self.rows[at : at + len(found[:free])] = found[:free]
        self.known |= zip(islice(new, free), range(at, REMEMBERED))
        places = np.array([new[w] if k is None else k for w, k in zip(words, places)], np.int64)
        out = self.rows.take(places, axis=0, mode="clip")
        unknown = places >= REMEMBERED
        out[unknown] = found[places[unknown] - REMEMBERED]
        return out


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, size, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of (n, 3) word rows, padded at the end for the widest filter."""
        E = self.embedding
        x = np.zeros((len(ids) + max(self.filters) - 1, E.shape[1]), E.dtype)
        x[: len(ids)] = E.take(ids[:, 0], axis=0) + E.take(ids[:, 1], axis=0) + E.take(ids[:, 2], axis=0)
        return x

    def responses(self, ids: np.ndarray, width: int, x: np.ndarray | None = None) -> np.ndarray:
        """The filters of one width at every place of (n, 3) word rows, whose vectors may be given."""
        x = self.embedded(ids) if x is None else x
        n = len(ids)
        return sum(x[j : j + n] @ self.filters[width][j] for j in range(width)) + self.bias[width]

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Largest response of every filter over a whole text, at least 0; long texts are read in overlapping parts."""
        best = np.zeros(len(self.filters) * FILTERS, np.float32)
        over = max(self.filters) - 1
        for a in range(0, len(ids), SCORED):
            part = ids[a : a + SCORED + over]
            x = self.embedded(part)
            best = np.maximum(best, np.concatenate([self.responses(part, w, x).max(axis=0) for w in self.filters]))
        return best

    def scores(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        pooled = np.array([self.pooled(x) for x in texts]).reshape(-1, len(self.out))
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30)))


class Training:
    """A model with the sums of its squared gradients: Adagrad on the logistic loss.

    Gradients reach only the words that gave a filter its largest response. The
    first component of the embedding starts at each row's smoothed log odds of
    standing in toxic rather than clean texts (``seen``: clean and toxic texts by
    row), and one filter of each width starts on it. Labels of a single kind give
    that kind's smoothed rate, and there is nothing to learn.
    """

    def __init__(self, clean: int, toxic: int, seen: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        rate = (np.float32(toxic) + 0.5) / (clean + toxic + 1)
        E = rng.normal(0, 0.05, (ROWS, SIZE)).astype(np.float32)
        E[0] = 0
        K = {w: rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        b = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.model = Model(E, K, b, out, float(np.log(rate / (1 - rate))))
        self.rng = rng
        self.both = bool(clean and toxic)
        if not self.both:
            out[:] = 0
            return
        odds = np.log((seen[1] + PRIOR * rate) / (seen[0] + PRIOR * (1 - rate))) - np.log(rate / (1 - rate))
        E[:, 0] = odds / 4
        E[0] = 0
        for i, w in enumerate(WIDTHS):
            K[w][:, :, 0] = 0
            K[w][:, 0, 0] = 1.0
            b[w][0] = -0.5 * w
            out[i * FILTERS] = 1.0
        hist = {"E": np.full((ROWS, 1), 1e-6, np.float32), "out": np.full_like(out, 1e-6), "ob": 1e-6}
        self.hist = hist | {("K", w): np.full_like(K[w], 1e-6) for w in WIDTHS} | {("b", w): np.full_like(b[w], 1e-6) for w in WIDTHS}

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Steps over the texts in ``order``; returns the embedding rows that changed."""
        changed = [self._step([texts[d] for d in some], labels[some].astype(np.float32)) for some in (order[a : a + BATCH] for a in range(0, len(order), BATCH))]
        return np.unique(np.concatenate(changed)) if changed else np.zeros(0, np.int64)

    def _step(self, texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        model, hist = self.model, self.hist
        E, K, b, out = model.embedding, model.filters, model.bias, model.out

        def step(param, grad, key, rate):
            hist[key] += grad * grad
            param -= rate * grad / np.sqrt(hist[key])

        gK = {w: np.zeros_like(K[w]) for w in WIDTHS}
        gb = {w: np.zeros_like(b[w]) for w in WIDTHS}
        gout, gob = np.zeros_like(out), 0.0
        rows, grads = [], []
        for ids, label in zip(texts, y):
            if not len(ids):
                continue
            feats, places = [], []
            vectors = model.embedded(ids)
            for w in WIDTHS:
                r = model.responses(ids, w, vectors)
                p = r.argmax(axis=0)
                places.append(p)
                feats.append(np.maximum(r[p, np.arange(FILTERS)], 0))
            f = np.concatenate(feats)
            g = 1 / (1 + np.exp(-np.clip(f @ out + model.out_bias, -30, 30))) - label
            gout += g * f
            gob += g
            for i, w in enumerate(WIDTHS):
                gr = g * out[i * FILTERS : (i + 1) * FILTERS] * (feats[i] > 0)
                gb[w] += gr
                for j in range(w):
                    at = places[i] + j
                    inside = at < len(ids)
                    at = ids[np.minimum(at, len(ids) - 1)]
                    x = E[at].sum(axis=1) * inside[:, None]
                    gK[w][j] += x.T * gr
                    gx = (K[w][j] * gr).T * inside[:, None]
                    rows += [at[:, 0], at[:, 1], at[:, 2]]
                    grads += [gx, gx, gx]
        if not rows:
            return np.zeros(0, np.int64)
        n = len(texts)
        step(out, gout / n, "out", OUT_RATE)
        hist["ob"] += (gob / n) ** 2
        model.out_bias -= OUT_RATE * gob / n / np.sqrt(hist["ob"])
        for w in WIDTHS:
            step(K[w], gK[w] / n, ("K", w), FILTER_RATE)
            step(b[w], gb[w] / n, ("b", w), FILTER_RATE)
        at, where = np.unique(np.concatenate(rows), return_inverse=True)
        g = np.zeros((len(at), SIZE), np.float32)
        np.add.at(g, where, np.concatenate(grads) / n)
        hist["E"][at] += (g * g).mean(axis=1, keepdims=True)
        E[at] -= WORD_RATE * g / np.sqrt(hist["E"][at])
        E[0] = 0
        return at

    def _others(self) -> list[tuple[np.ndarray, np.ndarray]]:
        m, h = self.model, self.hist
        return [(m.out, h["out"]), *[(m.filters[w], h["K", w]) for w in WIDTHS], *[(m.bias[w], h["b", w]) for w in WIDTHS]]

    def table(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbered rows of SIZE + 1 weights: the embedding's ``rows`` with their sums, then all other weights and sums."""
        words = np.concatenate([self.model.embedding[rows], self.hist["E"][rows]], axis=1)
        flat = np.concatenate([[self.model.out_bias, self.hist["ob"]], *[x.ravel() for pair in self._others() for x in pair]])
        flat = np.pad(flat, (0, -len(flat) % (SIZE + 1))).reshape(-1, SIZE + 1)
        return np.concatenate([rows, ROWS + np.arange(len(flat))]), np.concatenate([words.astype(np.float64), flat])

    def take(self, rows: np.ndarray, weights: np.ndarray) -> None:
        """Sets the weights of :meth:`table`."""
        words = rows < ROWS
        self.model.embedding[rows[words]] = weights[words, :SIZE]
        self.hist["E"][rows[words]] = weights[words, SIZE:]
        flat = weights[~words][np.argsort(rows[~words])].ravel()
        if not len(flat):
            return
        self.model.out_bias, self.hist["ob"] = float(flat[0]), float(flat[1])
        a = 2
        for x in (x for pair in self._others() for x in pair):
            x[...] = flat[a : a + x.size].reshape(x.shape)
            a += x.size


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> Model:
    """A model of texts at hand, in one shard (see :class:`Training`)."""
    seen = np.zeros((2, ROWS))
    for ids, t in zip(texts, labels):
        seen[int(t), np.unique(ids)] += 1
    training = Training(int((labels == 0).sum()), int((labels != 0).sum()), seen, seed)
    for _ in range(epochs * training.both):
        training.learn(texts, labels, training.rng.permutation(len(texts)))
    return training.model


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str], least: int = 20) -> dict[str, float]:
    """Per language the threshold of the best F1, halfway between neighbouring scores; too few positives: 0.5."""
    found = {}
    for lang in sorted(set(langs)):
        mine = np.array([x == lang for x in langs])
        s, t = scores[mine], labels[mine]
        if t.sum() < least or t.all():
            continue
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(t[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + t.sum())
        f1[:-1][np.diff(s[order]) == 0] = 0
        best = int(f1.argmax())
        below = s[order][best + 1] if best + 1 < len(s) else 0.0
        found[lang] = float((s[order][best] + below) / 2)
    return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def thresholds(scored: DataFrame, least: int = 20) -> dict[str, float]:
    """:func:`calibrate` over any number of rows (lang, score, toxic): running sums along the scores; one row a language returns."""
    counts = scored.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    totals = counts.groupBy("lang").agg(F.sum("hits").alias("toxic"), F.sum("n").alias("all")).filter((F.col("toxic") >= least) & (F.col("toxic") < F.col("all")))
    sums = running_sum(counts.withColumn(POS, F.col("score")), ["lang"], {"_n": "n", "_hits": "hits"}, descending=True).join(totals, "lang")
    best = sums.groupBy("lang").agg(F.max_by("score", F.struct(2 * F.col("_hits") / (F.col("_n") + F.col("toxic")), F.col("score"))).alias("best"))
    below = F.coalesce(F.max(F.when(F.col("score") < F.col("best"), F.col("score"))), F.lit(0.0))
    return {r["lang"]: r["at"] for r in counts.join(best, "lang").groupBy("lang").agg(((F.first("best") + below) / 2).alias("at")).orderBy("lang").collect()}


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled document that is not held out, as (toxic, lang, apart, ids) in partitions of about SHARD, which stay as they are.

    Only texts whose id may be labelled are shuffled, once; rows that repeat an id meet in the
    order of their texts, and the first is taken.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(~held_out(F.col("doc_id")))
    known = cut(known)
    shards = max(1, -(-known.count() // SHARD))
    maybe, _ = sieve(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), F.coalesce("lang", F.lit("")).alias("lang")), "doc_id", known, "doc_id")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("thresholds")), F.lit(CALIBRATED)) == 0
    rows = maybe.repartition(shards, "doc_id").join(known.repartition(shards, "doc_id"), "doc_id").withColumn("apart", apart)
    # a join of tables too large to be sent whole may be planned with another number of partitions
    rows = rows.coalesce(shards).select(F.xxhash64("doc_id").alias("_order"), F.col("doc_id").cast("string").alias("_id"), "_text", "lang", "toxic", "apart")

    def hash_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, last = Hasher(), None
        for pdf in batches:
            new = pdf["_id"].ne(pdf["_id"].shift(fill_value=last))
            last = pdf["_id"].iloc[-1] if len(pdf) else last
            pdf = pdf[new]
            yield pd.DataFrame({"toxic": pdf["toxic"], "lang": pdf["lang"], "apart": pdf["apart"], "ids": [zlib.compress(hasher(x).tobytes(), 1) for x in pdf["_text"]]})

    with modest_batches(docs.sparkSession):
        return cut(rows.sortWithinPartitions("_order", "_id", "_text", "lang").mapInPandas(lean(hash_words), "toxic int, lang string, apart boolean, ids binary"))


def _words(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x), np.int32).reshape(-1, 3) for x in pdf["ids"]]


def _seen(rows: DataFrame) -> np.ndarray:
    """How many clean and toxic texts each embedding row stands in; a table as large as the embedding."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, ROWS), np.int64)
        for pdf in batches:
            for ids, t in zip(_words(pdf), pdf["toxic"]):
                seen[int(t), np.unique(ids)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"row": at, "clean": seen[0, at], "toxic": seen[1, at]})

    found = rows.mapInPandas(lean(count), "row long, clean long, toxic long").groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, ROWS))
    seen[:, found["row"].to_numpy()] = [found["clean"].to_numpy(), found["toxic"].to_numpy()]
    return seen


def train_toxicity(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """A model fitted on every labelled document that is not held out.

    One in ``CALIBRATED`` of them, by id hash, is kept from the network: thresholds
    are set on these rows alone, on all of them. A document labelled twice is toxic
    if one label says so; null labels and null ids are left out; of texts that
    repeat an id the smallest counts.

    Texts are hashed to word rows once and stay on the executors. In each pass
    every shard learns from the same weights; of a word's weights those of the shards
    that changed them are averaged, of the others all. Only counts and weights, as many as the
    model has, reach the driver; averages are of whole numbers, so reruns agree.
    """
    rows = _labelled(docs, labels)
    taught = rows.filter("not apart").select("toxic", "ids")
    numbers = {r["toxic"] != 0: r["n"] for r in taught.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    training = Training(numbers.get(False, 0), numbers.get(True, 0), _seen(taught) if len(numbers) == 2 else np.zeros((2, ROWS)), seed)
    weights = [f"w{k}" for k in range(SIZE + 1)]
    context = docs.sparkSession.sparkContext
    for turn in range(EPOCHS * training.both):
        sent = context.broadcast(training)  # a fixed number of weights

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine, rng, changed = copy.deepcopy(sent.value), np.random.default_rng((seed, turn)), []
            for pdf in batches:
                if len(pdf):
                    changed.append(mine.learn(_words(pdf), pdf["toxic"].to_numpy() != 0, rng.permutation(len(pdf))))
            if changed:
                at, learnt = mine.table(np.unique(np.concatenate(changed)).astype(np.int64))
                yield pd.DataFrame({"row": at} | dict(zip(weights, np.rint(learnt * GRAIN).astype(np.int64).T)))

        found = taught.mapInPandas(lean(learn), "row long, " + ", ".join(f"{w} long" for w in weights)).groupBy("row").agg(F.count("*").alias("n"), *[F.sum(w).alias(w) for w in weights]).toArrow()
        training.take(found["row"].to_numpy(), np.stack([found[w].to_numpy() for w in weights], axis=1) / found["n"].to_numpy()[:, None] / GRAIN)
        sent.unpersist()
    model = training.model
    judge = context.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "score": judge.value.scores(_words(pdf)), "toxic": pdf["toxic"]})

    model.thresholds = thresholds(cut(rows.filter("apart").select("lang", "toxic", "ids").mapInPandas(lean(score), "lang string, score double, toxic int")))
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` with struct ``_toxic``: score, threshold, flagged.

    The score reads the whole text and nothing else; null texts are empty texts
    and get the score of no words. The threshold is the language's, 0.5 for
    languages that were not calibrated and for null. Repeated rows score alike;
    an empty table stays empty. Columns may have any name but ``_toxic``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    @F.pandas_udf("double")
    @lean
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, model = Hasher(), sent.value
        for texts in parts:
            yield pd.Series(model.scores(map(hasher, texts)), dtype="float64")

    rows, held, back = sheltered(docs)
    limit = F.lit(0.5)
    for lang, at in model.thresholds.items():
        limit = F.when(F.col(held[lang_col]) == lang, F.lit(at)).otherwise(limit)
    scored = rows.withColumn("_score", score(F.coalesce(F.col(held[text_col]), F.lit("")))).withColumn("_limit", limit)
    made = F.struct(F.col("_score").alias("score"), F.col("_limit").alias("threshold"), (F.col("_score") >= F.col("_limit")).alias("flagged"))
    return scored.select(*back, made.alias("_toxic"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_toxic.score", (F.col("_toxic.score") >= 0.5).cast("int").alias("predicted"), "_toxic.threshold", "_toxic.flagged")
