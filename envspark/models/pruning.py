"""Cost-complexity pruning of regression trees: weakest links first, from the node table of a fitted tree."""

from __future__ import annotations

import math
from collections.abc import Sequence
from heapq import heapify, heappop, heappush
from multiprocessing.pool import ThreadPool
from statistics import fmean, stdev

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.models.estimators import node_stats
from envspark.models.search import Folds

NODES = "node int, parent int, depth int, leaf int, n double, prediction double, risk double, subtree_risk double, leaves int, alpha double"


def node_table(model: PipelineModel) -> list[dict]:
    """The nodes of a fitted regression tree in pre-order, each before its children, left before right.

    ``risk`` is the squared error a node would leave as a leaf, ``leaf`` the
    number of a leaf from the left. As large as the model, which the driver holds.
    """
    rows: list[dict] = []
    open_ = [(model.stages[-1]._java_obj.rootNode(), None, 0)]
    leaves = 0
    while open_:
        node, parent, depth = open_.pop()
        stats = node.impurityStats()
        n = float(stats.count())
        inner = "InternalNode" in node.getClass().getSimpleName()
        rows.append({"node": len(rows), "parent": parent, "depth": depth, "leaf": None if inner else leaves, "n": n, "prediction": float(node.prediction()), "risk": n * float(stats.calculate())})
        leaves += not inner
        if inner:
            open_ += [(child, len(rows) - 1, depth + 1) for child in (node.rightChild(), node.leftChild())]
    return rows


def weakest_links(nodes: list[dict]) -> list[dict]:
    """The nodes with subtree risk, leaves below, and ``alpha``: the cost of a leaf from which on the node is a leaf itself.

    Each step cuts the links that save least per leaf, and all that tie with
    them, so the trees of rising alphas are nested. A step touches what is cut
    and the nodes above it, not the whole tree. A leaf's alpha is zero; a
    node below a cut takes no part any more and keeps the alpha at which it was
    cut off at the latest.
    """
    kids: dict[int, list[int]] = {}
    for x in nodes:
        if x["parent"] is not None:
            kids.setdefault(x["parent"], []).append(x["node"])
    alpha = {x["node"]: None if x["node"] in kids else 0.0 for x in nodes}
    parent = {x["node"]: x["parent"] for x in nodes}
    risk, leaves = {x["node"]: x["risk"] for x in nodes}, dict.fromkeys(alpha, 1)
    whole = dict(risk)

    def sum_up(i: int) -> float:
        """What a link saves per leaf, after the risk and leaves below it are summed up again."""
        risk[i], leaves[i] = sum(risk[k] for k in kids[i]), sum(leaves[k] for k in kids[i])
        return (whole[i] - risk[i]) / (leaves[i] - 1)

    gain = {x["node"]: sum_up(x["node"]) for x in reversed(nodes) if x["node"] in kids}
    first_risk, first_leaves = dict(risk), dict(leaves)
    open_ = [(g, i) for i, g in gain.items()]
    heapify(open_)
    low, tie = 0.0, 1e-12 * nodes[0]["risk"]
    while alpha[0] is None:
        cut: list[int] = []
        while open_ and (not cut or open_[0][0] <= low + tie):
            g, i = heappop(open_)
            if alpha[i] is None and g == gain[i]:  # else the link is gone, or its gain has changed since
                low = low if cut else max(low, g)
                cut.append(i)
        tops = list(cut)
        while cut:
            i = cut.pop()
            if alpha[i] is None:
                alpha[i] = low
                cut += kids[i]
        changed = set()
        for i in tops:
            risk[i], leaves[i] = whole[i], 1
            at = parent[i]
            while at is not None and at not in changed:
                changed.add(at)
                at = parent[at]
        for i in sorted(changed, reverse=True):  # children come after their parents
            if alpha[i] is None:
                gain[i] = sum_up(i)
                heappush(open_, (gain[i], i))
    return [x | {"subtree_risk": first_risk[x["node"]], "leaves": first_leaves[x["node"]], "alpha": alpha[x["node"]]} for x in nodes]


def top(nodes: list[dict], depth: int) -> tuple[list[dict], dict[int, int]]:
    """The nodes of a tree down to ``depth``, numbered anew, and for each leaf of the whole tree the leaf above it.

    Splits are chosen node by node, so this is the tree that is grown no deeper.
    """
    kept: list[dict] = []
    new: dict[int, int] = {}  # place of a node, or of the leaf above it
    above: dict[int, int] = {}
    for x in nodes:
        if x["depth"] > depth:
            new[x["node"]] = new[x["parent"]]
        else:
            new[x["node"]] = len(kept)
            end = x["leaf"] is not None or x["depth"] == depth
            kept.append(x | {"node": len(kept), "parent": None if x["parent"] is None else new[x["parent"]], "leaf": 0 if end else None})
        if x["leaf"] is not None:
            above[x["leaf"]] = new[x["node"]]
    places = {x["node"]: k for k, x in enumerate(x for x in kept if x["leaf"] is not None)}
    return [x | {"leaf": places.get(x["node"])} for x in kept], {leaf: places[at] for leaf, at in above.items()}


def pruning_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """NODES rows of a fitted regression tree with the alphas at which its links are cut."""
    names = [c.split()[0] for c in NODES.split(", ")]
    return spark.createDataFrame([tuple(x[c] for c in names) for x in weakest_links(node_table(model))], NODES)


def sequence(model: PipelineModel) -> list[tuple[float, int, float]]:
    """The nested trees as (alpha, leaves, squared error), from the smallest alpha to that of the root alone."""
    nodes = weakest_links(node_table(model))
    out = []
    for a in sorted({x["alpha"] for x in nodes if x["leaf"] is None}):
        inside = [True] * len(nodes)  # whether the node is reached from the root
        ends = []
        for x in nodes:
            inside[x["node"]] = x["parent"] is None or inside[x["parent"]] and nodes[x["parent"]]["alpha"] > a
            if inside[x["node"]] and (x["leaf"] is not None or x["alpha"] <= a):
                ends.append(x)
        out.append((a, len(ends), sum(x["risk"] for x in ends)))
    return out


def leaf_predictions(nodes: list[dict], costs: Sequence[float]) -> list[tuple[int, float, float]]:
    """(leaf, cost, prediction): what every leaf's rows get from the tree pruned at each cost, a share of the root's risk per leaf."""
    nodes = weakest_links(nodes)
    out = []
    for x in nodes:
        if x["leaf"] is None:
            continue
        path, at = [], x
        while at is not None:
            path.append(at)
            at = None if at["parent"] is None else nodes[at["parent"]]
        for cost in costs:
            closed = [p for p in path if p["leaf"] is None and p["alpha"] <= cost * nodes[0]["risk"]]
            out.append((x["leaf"], float(cost), (closed[-1] if closed else x)["prediction"]))
    return out


def pruned(model: PipelineModel, df: DataFrame, costs: Sequence[float]) -> DataFrame:
    """The rows of ``df`` once for every cost, with ``cost`` and the ``prediction`` of the tree pruned at it.

    Rows go down the tree once. The table of predictions holds a number for
    each leaf of the model and cost, so it is broadcast.
    """
    tree = model.stages[-1].copy()
    tree.setLeafCol("_leaf")
    prepared = df if "features" in df.columns else PipelineModel(model.stages[:-1]).transform(df)
    table = df.sparkSession.createDataFrame(leaf_predictions(node_table(model), costs), "_at int, cost double, _value double")
    scored = tree.transform(prepared).withColumn("_at", F.col("_leaf").cast("int")).join(F.broadcast(table), "_at")
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], "cost", F.col("_value").alias("prediction"))


def tune_tree(pipeline, df: DataFrame, depths: Sequence[int], costs: Sequence[float], fold_col: str = "fold", parallelism: int = 4) -> DataFrame:
    """Every depth with every cost by cross-validated RMSE: depth, cost, mean, std_err, folds, best.

    One tree is grown per fold, to the largest depth; those of smaller depths
    are its tops (:func:`top`). The held-out rows go down it once, and their
    number, mean and variance in every leaf give the errors of all depths and
    costs. Lower costs win ties, then smaller depths.
    """
    tree = pipeline.getStages()[-1]
    y = tree.getLabelCol()
    folds = Folds(pipeline.getStages()[:-1], df, fold_col, [y], parallelism)

    def score(part: tuple[DataFrame, DataFrame]) -> dict[tuple[int, float], float]:
        train, held_out = part
        model = PipelineModel([tree.fit(train, {tree.maxDepth: max(depths)})])
        nodes = node_table(model)
        ends = node_stats(model, held_out, y).collect()  # as many rows as the model has leaves
        n = sum(r["n"] for r in ends)
        errors = {}
        for depth in depths:
            short, above = top(nodes, depth)
            said = {(leaf, cost): p for leaf, cost, p in leaf_predictions(short, costs)}
            for cost in costs:
                errors[depth, cost] = math.sqrt(math.fsum(r["n"] * (r["variance"] + (r["mean"] - said[above[int(r["leaf"])], float(cost)]) ** 2) for r in ends) / n)
        return errors

    with ThreadPool(parallelism) as pool:
        scores = pool.map(inheritable_thread_target(df.sparkSession)(score), folds.parts, chunksize=1)
    folds.close()
    k = len(folds.names)
    rows = [(int(d), float(c), fmean(x), stdev(x) / k**0.5 if k > 1 else None, k) for d in depths for c in costs if (x := [s[d, c] for s in scores])]
    best = min(rows, key=lambda r: (r[2], r[1], r[0]))
    return df.sparkSession.createDataFrame([(*r, r is best) for r in rows], "depth int, cost double, mean double, std_err double, folds int, best boolean")
