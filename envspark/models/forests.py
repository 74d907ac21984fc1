"""Classification forests of a whole search, grown together: one pass over the rows per level for all folds, candidates and trees.

Trees are those of Spark's ``RandomForestClassifier``: features are cut into bins once per fold, nodes take the split of
largest gain among the features drawn for them, rows weigh as often as they are drawn. Rows are packed into blocks of bin
numbers. Tasks count classes per node, feature and bin, the counts of a tree are summed and its splits chosen in a shuffle,
and the driver holds the trees. Only the draws differ from Spark's; they follow the block, so a repeated pass draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.session import remove, staged

#: Rows of a block, nodes of a tree that are counted at a time, and bytes of counts that a pass shuffles at most (one candidate at least).
BLOCK_ROWS, NODES, PASS_BYTES = 1 << 18, 256, 1 << 30

#: Sampled rows from which bins are cut: as many as Spark takes.
CUT_ROWS = 10_000

#: What may differ between candidates.
VARIED = {"numTrees", "maxDepth", "minInstancesPerNode", "minInfoGain", "featureSubsetStrategy", "impurity", "subsamplingRate", "bootstrap", "seed"}

BLOCKS = "fold int, held boolean, block long, rows int, codes binary, labels binary"
COUNTS = "fold int, candidate int, tree int, part int, counts binary"
SPLITS = "fold int, candidate int, tree int, part int, feature binary, goes_right binary, own binary, left binary"


class Spec(NamedTuple):
    """A candidate's parameters."""

    trees: int
    depth: int
    min_n: int
    min_gain: float
    subset: str
    impurity: str
    rate: float
    bootstrap: bool
    seed: int

    def mtry(self, features: int) -> int:
        """Features tried per split, by Spark's names, a number of them or a share."""
        named = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))), "onethird": math.ceil(features / 3)}
        named["auto"] = named["sqrt"] if self.trees > 1 else features
        return named[self.subset] if self.subset in named else min(int(self.subset), features) if self.subset.isdigit() else math.ceil(float(self.subset) * features)


class Bins(NamedTuple):
    """How a fold's features are cut: thresholds of numbers, values of categories, and which of these split into any two sets."""

    classes: int
    cuts: list  # per feature: thresholds, or None
    arity: list  # per feature: number of categories, or None
    unordered: list

    def width(self) -> int:
        return max(a or len(c) + 1 for c, a in zip(self.cuts, self.arity))


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    return values.take(places, mode="clip")  # all are inside; so numpy spares a copy


class Tree:
    """A tree as arrays over its nodes. A row at a node goes to ``child``, or to the next node if ``goes_right`` has its bin; leaves are their own children."""

    def __init__(self, width: int):
        self.child, self.feature = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.goes_right = np.zeros((1, width), np.uint8)
        self.counts = None
        self.open = np.zeros(1, np.int64)  # nodes to split next
        self.tried = None  # the features drawn for each of them

    def walk(self, codes: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
        """The node of each row after so many steps; ``start`` is where its bins begin in ``codes``."""
        width, next_ = self.goes_right.shape[1], (self.child[:, None] + self.goes_right).ravel()
        at = np.zeros(len(start), np.int64)
        for _ in range(steps):
            at = _at(next_, at * width + _at(codes, start + _at(self.feature, at)))
        return at

    def draw(self, spec: Spec, number: int, level: int, features: int) -> None:
        order = np.random.default_rng([spec.seed % (1 << 64), 1, number, level]).random((len(self.open), features)).argsort(axis=1)
        self.tried = np.sort(order[:, : spec.mtry(features)], axis=1)

    def split(self, parts: list[tuple], spec: Spec, level: int) -> None:
        """Take the splits chosen for the open nodes, as :func:`best_splits` gives them for each part."""
        feature, goes_right, own, left = (np.concatenate(x) for x in zip(*parts))
        if self.counts is None:
            self.counts = own
        found = (feature >= 0) & (level < spec.depth)
        at, left, right = self.open[found], left[found], (own - left)[found]
        first = len(self.child) + 2 * np.arange(len(at))
        self.child[at], self.feature[at], self.goes_right[at] = first, feature[found], goes_right[found]
        kids = np.stack([first, first + 1], axis=1).ravel()
        new = np.stack([left, right], axis=1).reshape(len(kids), own.shape[1])
        self.child, self.feature = np.concatenate([self.child, kids]), np.concatenate([self.feature, np.zeros_like(kids)])
        self.goes_right = np.concatenate([self.goes_right, np.zeros((len(kids), self.goes_right.shape[1]), np.uint8)])
        self.counts = np.concatenate([self.counts, new])
        more = (new.max(axis=1) < new.sum(axis=1)) & (new.sum(axis=1) >= 2 * spec.min_n) & (level + 1 < spec.depth)  # others stay leaves
        self.open = kids[more]

    def prune(self) -> None:
        """Nodes whose leaves all say one class are leaves, as in Spark's trees."""
        says = self.counts.argmax(axis=1)
        for at in range(len(self.child) - 1, -1, -1):
            left = self.child[at]
            if left != at and self.child[left] == left and self.child[left + 1] == left + 1 and says[left] == says[left + 1]:
                self.child[at], self.goes_right[at] = at, 0


def can_grow(estimator, points: Sequence[dict], evaluator) -> bool:
    """Whether a search is over forests as grown here, scored by an evaluator that takes many candidates at once."""
    return (
        type(estimator) is RandomForestClassifier
        and hasattr(evaluator, "evaluate_by")
        and evaluator.digits is not None
        and not any(estimator.isSet(p) for p in ("weightCol", "thresholds"))
        and estimator.getMinWeightFractionPerNode() == 0
        and all(point.keys() <= VARIED for point in points)
    )


def spec_of(estimator: RandomForestClassifier, params: dict) -> Spec:
    f = estimator.copy(params)
    return Spec(f.getNumTrees(), f.getMaxDepth(), f.getMinInstancesPerNode(), f.getMinInfoGain(), f.getFeatureSubsetStrategy().lower(), f.getImpurity().lower(), f.getSubsamplingRate(), f.getBootstrap(), f.getSeed())


def thresholds(values: np.ndarray, splits: int) -> np.ndarray:
    """At most ``splits`` thresholds between distinct values, all there are or else at even counts."""
    at, n = np.unique(values, return_counts=True)
    middle = (at[:-1] + at[1:]) / 2
    if len(middle) <= splits:
        return middle
    stride = target = len(values) / (splits + 1)
    kept, below = [], np.cumsum(n)
    for i in range(len(middle)):
        if abs(below[i] - target) < abs(below[i + 1] - target):
            kept.append(middle[i])
            target += stride
    return np.array(kept)


def categories(df: DataFrame, column: str) -> dict[int, int]:
    """The number of values of every nominal feature, from the column's attributes."""
    attrs = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    known = {a["idx"]: len(a["vals"]) if "vals" in a else a.get("num_vals") for a in attrs.get("nominal", [])}
    return {i: n for i, n in known.items() if n} | {a["idx"]: 2 for a in attrs.get("binary", [])}


def find_bins(train: DataFrame, column: str, rows: int, classes: int, max_bins: int, seed: int) -> Bins:
    """A fold's bins, cut from a sample of bounded size as Spark does."""
    if classes < 2:
        raise ValueError("a forest needs rows of two classes at least")
    most = min(max_bins, rows)
    share = max(most * most, CUT_ROWS) / rows
    sample = (train if share >= 1 else train.sample(share, seed)).select(vector_to_array(column).alias("x")).toArrow().column("x").combine_chunks()
    x = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1)
    known = categories(train, column)
    arity = [known.get(i) for i in range(x.shape[1])]
    if (largest := max((a for a in arity if a), default=0)) > most:
        raise ValueError(f"maxBins (or rows) of {most} must cover the {largest} values of a category")
    free = int(math.log(most // 2 + 1) / math.log(2) + 1)  # up to so many values, every pair of sets is a split
    return Bins(classes, [None if a else thresholds(x[:, i], most - 1) for i, a in enumerate(arity)], arity, [bool(a) and classes > 2 and a <= free for a in arity])


def pack(part: DataFrame, column: str, label: str, fold: int, held: bool, bins: Bins) -> DataFrame:
    """The rows as BLOCKS of bin numbers."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept = TaskContext.get().partitionId() << 24, []
        kind = np.min_scalar_type(bins.width() - 1)

        def block() -> pa.RecordBatch:
            codes, labels = (np.concatenate(x) for x in zip(*kept))
            return pa.RecordBatch.from_pydict({"fold": pa.array([fold], pa.int32()), "held": [held], "block": pa.array([number], pa.int64()), "rows": pa.array([len(labels)], pa.int32()), "codes": [codes.tobytes()], "labels": [labels.tobytes()]})

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.stack([x[:, i] if c is None else np.searchsorted(c, x[:, i]) for i, c in enumerate(bins.cuts)], axis=1).astype(kind)
            kept.append((codes, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)))
            if sum(len(k[1]) for k in kept) >= BLOCK_ROWS:
                yield block()
                number, kept = number + 1, []
        if kept:
            yield block()

    return part.select(F.col(label).alias("y"), vector_to_array(column).alias("x")).mapInArrow(blocks, BLOCKS)


def drawn(spec: Spec, block: int, tree: int, rows: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree."""
    rng = np.random.default_rng([spec.seed % (1 << 64), 0, block, tree])
    if spec.bootstrap:  # Poisson, by the shares of 0, 1, 2 ... draws
        shares = np.cumsum([math.exp(-spec.rate) * spec.rate**k / math.factorial(k) for k in range(30)])
        return shares.searchsorted(rng.random(rows), side="right")
    return np.ones(rows, np.int64) if spec.rate >= 1 else (rng.random(rows) < spec.rate).astype(np.int64)


def read_block(row, bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin numbers in one line, where each row begins in it, and labels."""
    codes = np.frombuffer(row.codes, np.min_scalar_type(bins.width() - 1))
    return codes, np.arange(row.rows) * len(bins.cuts), np.frombuffer(row.labels, np.int32)


def count_classes(tree: Tree, codes: np.ndarray, cells: np.ndarray, start: np.ndarray, weights: np.ndarray, level: int, classes: int, nodes: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, counts by node, tried feature, bin and class) of a tree's open nodes, ``nodes`` of them a part; ``cells`` are bins times classes plus the label."""
    place = np.full(len(tree.child), -1)
    place[tree.open] = np.arange(len(tree.open))
    node = _at(place, tree.walk(codes, start, level))
    width, tries = tree.goes_right.shape[1] * classes, tree.tried.shape[1]
    for part, low in enumerate(range(0, len(tree.open), nodes)):
        size = min(nodes, len(tree.open) - low)
        at, w, here, inside = node - low, weights, start, (node >= low) & (node < low + size)
        if not inside.all():
            at, w, here = at[inside], w[inside], here[inside]
        cell, counts = at * width, np.empty((size, tries, width), np.int32)
        for j in range(tries):
            tried = tree.tried[low : low + size, j]
            key = cell + _at(cells, here + (tried[0] if size == 1 else _at(tried, at)))
            counts[:, j] = np.bincount(key, w, size * width).reshape(size, width)
        yield part, counts


def impurity(counts: np.ndarray, kind: str) -> np.ndarray:
    total = counts.sum(axis=-1)
    share = counts / np.maximum(total, 1)[..., None]
    out = np.ones(total.shape) if kind == "gini" else np.zeros(total.shape)
    for k in range(counts.shape[-1]):
        f = share[..., k]
        out -= f * f if kind == "gini" else f * (np.log(np.where(f > 0, f, 1)) / math.log(2))
    return np.where(total > 0, out, 0.0)


def best_splits(counts: np.ndarray, tried: np.ndarray, bins: Bins, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the feature, the bins that go right, its own and the left side's counts; the feature is -1 where no split gains."""
    size, _, width, classes = counts.shape
    own = counts[:, 0].sum(axis=1)
    whole, n = impurity(own, spec.impurity), own.sum(axis=1)
    gain = np.zeros(size)  # what is not above zero is no split
    feature, lefts, goes_right = np.full(size, -1), np.zeros((size, classes), np.int64), np.zeros((size, width), np.uint8)
    for f in range(len(bins.cuts)):
        node, j = np.nonzero(tried == f)  # a node at most once
        values = bins.arity[f] or len(bins.cuts[f]) + 1
        if not len(node) or values < 2:
            continue
        here = counts[node, j, :values]
        if bins.unordered[f]:
            sets = np.arange(1, 1 << (values - 1))[:, None] >> np.arange(values) & 1  # the values on the left of each split
            left = np.einsum("sv,mvc->msc", sets, here)
            right_of = 1 - np.broadcast_to(sets, (len(node), *sets.shape))
        else:
            rank = np.broadcast_to(np.arange(values), (len(node), values))
            if bins.arity[f]:  # by impurity, or of two classes by the second; absent values last
                centre = impurity(here, spec.impurity) if classes > 2 else here[..., 1].astype(float)
                order = np.where(here.sum(axis=-1) > 0, centre, np.inf).argsort(axis=1, kind="stable")
                here, rank = np.take_along_axis(here, order[..., None], axis=1), order.argsort(axis=1)
            left = here.cumsum(axis=1)[:, :-1]
            right_of = rank[:, None] > np.arange(values - 1)[:, None]
        right = own[node][:, None] - left
        nl, nr = left.sum(axis=-1), right.sum(axis=-1)
        all_ = np.maximum(n[node], 1)[:, None]
        gains = whole[node][:, None] - nl / all_ * impurity(left, spec.impurity) - nr / all_ * impurity(right, spec.impurity)
        gains = np.where((nl >= spec.min_n) & (nr >= spec.min_n) & (gains >= spec.min_gain), gains, -np.inf)
        at = gains.argmax(axis=1)
        m = np.flatnonzero(gains[np.arange(len(node)), at] > gain[node])
        k, at = node[m], at[m]
        gain[k], feature[k], lefts[k], goes_right[k] = gains[m, at], f, left[m, at], 0
        goes_right[k, :values] = right_of[m, at]
    return feature, goes_right, own, lefts


def _dealt(blocks: DataFrame, candidates: int, tasks: int) -> DataFrame:
    """The blocks, once for each group of candidates, a task each: as many groups as make ``tasks`` of few blocks."""
    n = blocks.count()
    groups = max(1, min(candidates, -(-tasks // max(n, 1))))
    each = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("groups", F.lit(groups))
    return each.repartitionByRange(max(1, n * groups), "block", "group")


class Search:
    """Forests of every fold and candidate: grown by :meth:`grow`, held-out rows scored by :meth:`scored`."""

    def __init__(self, folds, estimator: RandomForestClassifier, specs: Sequence[Spec], parallelism: int):
        self.specs, self.spark = specs, folds.rows.sparkSession
        column, self.label = estimator.getFeaturesCol(), estimator.getLabelCol()
        found = folds.rows.groupBy(folds.fold_col, self.label).count().collect()  # folds times classes
        if any(y is None or y < 0 or y % 1 for _, y, _ in found):
            raise ValueError(f"labels in {self.label} must be 0, 1, 2 ...")

        def bins(k: int) -> Bins:
            seen = [(r[1], r[2]) for r in found if r[0] != folds.names[k]]
            return find_bins(folds.parts[k][0], column, sum(n for _, n in seen), int(max((y for y, _ in seen), default=0)) + 1, estimator.getMaxBins(), estimator.getSeed())

        with ThreadPool(parallelism) as pool:
            self.bins = pool.map(inheritable_thread_target(self.spark)(bins), range(len(folds.names)))
        packed = [pack(df, column, self.label, k, bool(held), self.bins[k]) for k, parts in enumerate(folds.parts) for held, df in enumerate(parts)]
        self.blocks = staged(reduce(DataFrame.unionAll, packed), "blocks")
        self.tasks = 4 * self.spark.sparkContext.defaultParallelism
        self.forests = {(k, c): [Tree(b.width()) for _ in range(s.trees)] for k, b in enumerate(self.bins) for c, s in enumerate(specs)}

    def close(self) -> None:
        remove(self.blocks)

    def grow(self) -> None:
        units = _dealt(self.blocks.filter("NOT held"), len(self.specs), self.tasks).persist()
        blocks = units.filter(F.col("group") == 0).groupBy("fold").count().collect()
        blocks = {r["fold"]: r["count"] for r in blocks}
        for level in range(1 + max(s.depth for s in self.specs)):
            cost = {c: 0 for c in range(len(self.specs))}
            for (k, c), trees in self.forests.items():
                for t, tree in enumerate(trees):
                    tree.draw(self.specs[c], t, level, len(self.bins[k].cuts))
                    cost[c] += blocks.get(k, 0) * tree.tried.size * self.bins[k].width() * self.bins[k].classes * 4
            passes: list[list[int]] = []
            room = 0
            for c in (c for c in cost if cost[c]):
                if not passes or cost[c] > room:
                    passes.append([])
                    room = PASS_BYTES
                passes[-1].append(c)
                room -= cost[c]
            for some in passes:
                self._level(units, some, level)
        units.unpersist()
        for trees in self.forests.values():
            for tree in trees:
                tree.prune()

    def _level(self, units: DataFrame, some: list[int], level: int) -> None:
        """Split the open nodes of some candidates' trees."""
        specs, bins = self.specs, self.bins
        sent = self.spark.sparkContext.broadcast({(k, c): {t: tree for t, tree in enumerate(trees) if len(tree.open)} for (k, c), trees in self.forests.items() if c in some})

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in (r for frame in frames for r in frame.itertuples()):
                b = bins[row.fold]
                codes, start, labels = read_block(row, b)
                cells = (codes.reshape(row.rows, -1) * np.int32(b.classes) + labels[:, None]).ravel()
                mine = {c: sent.value[row.fold, c] for c in some if c % row.groups == row.group}
                for t in sorted({t for trees in mine.values() for t in trees}):
                    bags: dict[tuple, tuple] = {}  # candidates that draw alike share what is drawn
                    found = []
                    for c in (c for c in mine if t in mine[c]):
                        s = specs[c]
                        if (like := (s.seed, s.rate, s.bootstrap)) not in bags:
                            times = drawn(s, row.block, t, row.rows)
                            in_ = np.flatnonzero(times)
                            bags[like] = start[in_], times[in_].astype(np.float64)
                        found += [(row.fold, c, t, part, counts.tobytes()) for part, counts in count_classes(mine[c][t], codes, cells, *bags[like], level, b.classes, NODES)]
                    yield pd.DataFrame(found, columns=["fold", "candidate", "tree", "part", "counts"])

        def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def best(k: int, c: int, t: int, part: int, counts: np.ndarray) -> tuple:
                tried, b = sent.value[k, c][t].tried[part * NODES : (part + 1) * NODES], bins[k]
                return k, c, t, part, *(x.tobytes() for x in best_splits(counts.reshape(*tried.shape, b.width(), b.classes), tried, b, specs[c]))

            at, total = None, np.empty(0)
            for frame in frames:
                rows = []
                for *key, counts in frame.itertuples(index=False):  # sorted by key
                    more = np.frombuffer(counts, np.int32).astype(np.int64)
                    if key != at:
                        rows += [best(*at, total)] if at else []
                        at, total = key, more
                    else:
                        total += more
                yield pd.DataFrame(rows, columns=names)
            if at:
                yield pd.DataFrame([best(*at, total)], columns=names)

        names, keys = [x.split()[0] for x in SPLITS.split(", ")], ["fold", "candidate", "tree", "part"]
        counted = units.mapInPandas(count, COUNTS).repartition(self.tasks, *keys).sortWithinPartitions(*keys)
        chosen: dict[tuple, list] = {}  # a few numbers per open node, which the driver's trees hold as well
        for k, c, t, _, *found in sorted(tuple(r) for r in counted.mapInPandas(choose, SPLITS).collect()):
            feature, goes_right, own, left = map(np.frombuffer, found, (np.int64, np.uint8, np.int64, np.int64))
            chosen.setdefault((k, c, t), []).append((feature, *(x.reshape(len(feature), -1) for x in (goes_right, own, left))))
        for (k, c, t), parts in chosen.items():
            self.forests[k, c][t].split(parts, specs[c], level)
        sent.destroy()

    def scored(self) -> DataFrame:
        """(fold, candidate, label, probability) of every held-out row for every candidate."""
        bins, classes = self.bins, max(b.classes for b in self.bins)
        held = _dealt(self.blocks.filter("held"), len(self.specs), self.tasks)
        sent = self.spark.sparkContext.broadcast({at: [(t, t.counts / t.counts.sum(axis=1, keepdims=True)) for t in trees] for at, trees in self.forests.items()})
        depth, candidates = [s.depth for s in self.specs], range(len(self.specs))

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in (r for frame in frames for r in frame.itertuples()):
                codes, start, labels = read_block(row, bins[row.fold])
                for c in (c for c in candidates if c % row.groups == row.group):
                    votes = sum(share[tree.walk(codes, start, depth[c])] for tree, share in sent.value[row.fold, c])
                    votes = votes / votes.sum(axis=1, keepdims=True)
                    yield pd.DataFrame({"fold": row.fold, "candidate": c, "classes": votes.shape[1], "label": labels.astype(np.float64)} | {f"p{i}": votes[:, i] if i < votes.shape[1] else np.nan for i in range(classes)})

        rows = held.mapInPandas(score, "fold int, candidate int, classes int, label double, " + ", ".join(f"p{i} double" for i in range(classes)))
        p = F.slice(F.array(*[F.col(f"p{i}") for i in range(classes)]), F.lit(1), F.col("classes"))
        return rows.select("fold", "candidate", F.col("label").alias(self.label), p.alias("probability"))


def search_scores(folds, estimator: RandomForestClassifier, params: Sequence[dict], evaluator, parallelism: int) -> list[float]:
    """The evaluator's value for every candidate and fold, candidates outermost."""
    search = Search(folds, estimator, [spec_of(estimator, p) for p in params], parallelism)
    search.grow()
    found = evaluator.evaluate_by(search.scored(), ["candidate", "fold"])
    search.close()
    return [found[c, k] for c in range(len(params)) for k in range(len(folds.names))]
