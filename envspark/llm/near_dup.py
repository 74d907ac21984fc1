"""Operator 10, SimHash near-dedup: meet-in-the-middle ball hashing of fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import Rounds, connected, cut, lean, modest_batches, sheltered, sieve, star, table, tasks
from envspark.session import remove, staged

#: Shingles whose bits are counted at a time; bounds a worker's memory and changes no result.
COUNTED = 1 << 15

SEED = 42

#: Words of the long fingerprint around which balls are laid, and their bits.
BALLS, BITS = 4, 48

#: Marks keys that are variants of words, not words.
VARIANT = 1 << 52

#: Times the hubs of a key that the next round takes.
MORE_HUBS = 16

#: Pairs of a key that a round after the first may make whatever its number of hubs; keys of up to 256 ids end in it.
KEY_PAIRS = 1 << 16

#: Standard deviations by which two fingerprints may differ in more bits than expected before their shingles are compared.
MARGIN = 4.0

#: Ratio of the largest to the smallest size of sets that the later rounds file as one class.
SIZE_CLASS = 1.05

#: Distinct shingles from which on the share of differing bits is a normal variable.
COARSE = 64


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words joined by spaces, repeats included; a shorter text is one shingle.

    bytes.lower and bytes.split know ASCII only: A-Z, and the white space 0x20 and 0x09-0x0D.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word derived from a hash; the 0th is the hash itself, the others a splitmix64 step away."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints_of(hashes: list[np.ndarray], longs: int) -> np.ndarray:
    """A row of ``longs`` 64-bit words per text: a bit is 1 if it is set in over half of the text's hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(hashes), longs), np.int64)
    flat = np.concatenate(hashes) if len(hashes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(hashes)), sizes)
    for k in range(longs):
        ones = np.zeros((len(hashes), 64), np.int64)
        for a in range(0, len(flat), COUNTED):
            bits = np.unpackbits(_mixed(flat[a : a + COUNTED], k).astype(">u8").view(np.uint8)).reshape(-1, 64)
            here = owner[a : a + COUNTED]
            starts = np.flatnonzero(np.diff(here, prepend=-1))
            ones[here[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        set_bits = np.packbits(2 * ones > sizes[:, None], axis=1)
        out[:, k] = set_bits.view(">u8").astype(np.uint64).view(np.int64)[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int, longs: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp array<long>) for every row and whole text; null is empty, no words give zeros."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done: list[np.ndarray] = []
            some: list[np.ndarray] = []
            held = 0
            for text in pdf["_text"]:
                some.append(shingle_hashes(text, words))
                held += len(some[-1])
                if held >= 8 * COUNTED:
                    done.append(fingerprints_of(some, longs))
                    some, held = [], 0
            done.append(fingerprints_of(some, longs))
            yield pd.DataFrame({"doc_id": pd.array([None if x is None else int(x) for x in pdf["_id"]], "Int64"), "fp": list(np.concatenate(done))})

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInPandas(lean(compute), "doc_id long, fp array<long>")


def _masks(bits: int, flips: int, within: int | None = None) -> list[int]:
    """Masks of exactly ``flips`` set bits, all of them in one block of ``within`` bits; as signed longs."""
    width = within or bits
    blocks = [range(a, min(a + width, bits)) for a in range(0, bits, width)]
    found = {sum(1 << i for i in c) for block in blocks for c in combinations(block, flips)}
    return [m - (1 << 64) if m >> 63 else m for m in sorted(found)]


def ball_links(nodes: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """Links (u, v) that join up all distinct values ``fp`` differing in at most ``radius`` bits, and no others.

    Every value emits all variants within half the radius. Two that share a
    variant are within twice that half of each other, so all of a variant's
    values may be linked to the smallest of them: one link per member, however
    many values share the variant. For an odd radius, pairs exactly at the
    radius differ in parity: values of even parity emit one flip more than half,
    those of odd parity one flip less, and meet in a variant whose even and odd
    members are all within the radius; again each even one is linked to the
    variant's smallest odd one. Among 2h+1 differing bits, h+1 lie in one
    half of the value, so only flips inside one half are emitted there. No
    variant has more members than variants a value emits.
    """
    half = radius // 2
    nodes = nodes.repartition(tasks(nodes.sparkSession), "fp")
    ball = [m for k in range(half + 1) for m in _masks(bits, k)]
    links = star(nodes.select("fp", F.explode(F.lit(ball)).alias("_m")).select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("_variant")), "_variant", "fp")
    if radius % 2:
        odd = F.bit_count("fp") % 2 == 1
        far = nodes.filter(~odd).select("fp", F.explode(F.lit(_masks(bits, half + 1, (bits + 1) // 2))).alias("_m"))
        near = nodes.filter(odd).select("fp", F.explode(F.lit(_masks(bits, half))).alias("_m"))
        variant = F.col("fp").bitwiseXOR(F.col("_m")).alias("_variant")
        hubs = near.select("fp", variant).groupBy("_variant").agg(F.min("fp").alias("v"))
        # variants are many times what the planner takes them for: without the hint it would send them all through the driver
        met = far.select(F.col("fp").alias("u"), variant).join(hubs.hint("merge"), "_variant")
        links = links.union(met.select("u", "v"))
    return links


def near_components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Texts link when their 64-bit fingerprints over shingles of ``words`` words
    differ in at most ``radius`` bits; component_id is the smallest doc_id that
    can be reached over links. Equal fingerprints are one node, whatever their
    number; only fingerprints travel. Null and empty texts, and those of white
    space, have fingerprint zero and link like others. Null ids are returned
    and are never a component's id unless it has no other. Repeated rows are
    returned each; other columns are not read; an empty table gives no rows.
    """
    with modest_batches(docs.sparkSession):
        marked = cut(fingerprints(docs, words, 1, id_col, text_col).select("doc_id", F.col("fp")[0].alias("fp")))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected(ball_links(nodes, radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = cut(named.groupBy("root").agg(F.min("low").alias("component_id")))
    found = marked.join(named.join(lowest, "root").select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _lowest(hashes: list[np.ndarray], bands: int, rows: int) -> list[np.ndarray]:
    """``bands`` negative keys per text, each of the lowest of its hashes under ``rows`` orders; none for a text without words."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes) if len(hashes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(hashes)), sizes)
    rng = np.random.default_rng(SEED)
    keys = np.zeros((len(hashes), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            turn, odd = rng.integers(0, 1 << 64, 2, dtype=np.uint64)
            low = np.full(len(hashes), ~np.uint64(0))
            for a in range(0, len(flat), COUNTED):
                here = owner[a : a + COUNTED]
                starts = np.flatnonzero(np.diff(here, prepend=-1))
                least = np.minimum.reduceat((flat[a : a + COUNTED] ^ turn) * (odd | np.uint64(1)), starts)
                low[here[starts]] = np.minimum(low[here[starts]], least)
            keys[:, k // rows] = _mixed(keys[:, k // rows] ^ low, k + 1)
    keys = (keys | np.uint64(1 << 63)).view(np.int64)
    return [row if n else row[:0] for row, n in zip(keys, sizes)]


def sketches(docs: DataFrame, words: int, longs: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, digest, size, fp, bands) over the set of a text's shingles; ``digest`` names the set, ``size`` counts it."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done: list[tuple] = []
            some: list[np.ndarray] = []
            held = 0
            for at, text in enumerate(pdf["_text"], 1):
                some.append(np.unique(shingle_hashes(text, words)))
                held += len(some[-1])
                if held >= 8 * COUNTED or at == len(pdf):
                    done += zip([xxhash.xxh3_128_digest(x.tobytes()) for x in some], map(len, some), fingerprints_of(some, longs), _lowest(some, bands, rows))
                    some, held = [], 0
            yield pd.DataFrame({"doc_id": pd.array([int(x) for x in pdf["_id"]], "Int64"), **{name: [x[k] for x in done] for k, name in enumerate(("digest", "size", "fp", "bands"))}})

    named = docs.select(F.col(id_col).cast("long").cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return named.filter("_id is not null").mapInPandas(lean(compute), "doc_id long, digest binary, size long, fp array<long>, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, set): the distinct shingle hashes of the texts whose id is in ``ids``; an id with several texts has several."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                yield pd.DataFrame({"id": part["_id"], "set": [np.unique(shingle_hashes(x, words)).view(np.int64) for x in part["_text"]]})

    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    maybe, _ = sieve(named, "_id", ids, "id")
    # a semi join would be moved below the sieve, and all texts shuffled
    return maybe.join(ids.select(F.col("id").alias("_id")).distinct(), "_id").select("_id", "_text").mapInPandas(lean(compute), "id long, set array<long>").distinct()


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) with ``alike``, the Jaccard similarity of their shingle sets, exact."""
    both = pairs.join(sets.toDF("v", "_sv"), "v").join(sets.toDF("u", "_su"), "u")
    shared = F.size(F.array_intersect("_su", "_sv"))
    ratio = shared / F.greatest(F.size("_su") + F.size("_sv") - shared, F.lit(1))
    return both.select("u", "v", ratio.alias("alike")).groupBy("u", "v").agg(F.max("alike").alias("alike"))


def _members(nodes: DataFrame) -> DataFrame:
    """Rows (key, id) of keys that several ids share: equal bands, equal words, and words that share a variant.

    Words are the low ``BITS`` bits of the first ``BALLS`` parts of the long
    fingerprint. Each distinct word emits its variants within one flip, so that
    words up to two flips apart meet; words that do stand for all their ids.
    """
    words = F.transform(F.slice("fp", 1, BALLS), lambda x, at: F.shiftleft(at.cast("long"), BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))))
    parts = nodes.select("id", F.explode(F.concat(words, "bands")).alias("key"))
    counts = cut(parts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1 or key >= 0"))
    # keys and variants are many times what the planner takes them for, and must not be sent through the driver
    equal = parts.join(counts.filter("n > 1").select("key").hint("merge"), "key").select("key", "id")
    spread = counts.filter("key >= 0").select(F.col("key").alias("word")).repartition(tasks(nodes.sparkSession), "word")
    spread = spread.select("word", F.explode(F.lit([0, *_masks(BITS, 1)])).alias("_m")).select("word", F.col("word").bitwiseXOR(F.col("_m")).bitwiseOR(F.lit(VARIANT)).alias("variant"))
    met = cut(spread.withColumn("_n", F.count("*").over(W.partitionBy("variant"))).filter("_n > 1").drop("_n"))
    return cut(equal.union(met.hint("merge").join(parts.withColumnRenamed("key", "word"), "word").select("variant", "id")))


def similar_roots(nodes: DataFrame, docs: DataFrame, similarity: float, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, root) of the components of ids of a key whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    The root is a component's smallest id; ids alike to no other have no row.

    Keys are bands and balls around words of the fingerprint (:func:`_members`).
    Every link between two ids is verified on the shingle sets themselves, after its
    fingerprints, whose limit leaves a margin of four standard deviations.

    It goes in rounds. In each, a key's hubs are compared with its ids of other
    components, and leave the key; hubs are the smallest ids outside the key's
    largest component, so that one stranger among many copies costs one row a
    copy and no more rounds. A key is done when all its ids are of one
    component, after the first round for a group of copies. The second round's hub
    is the id with the largest share of shingles found elsewhere (:func:`_central`).
    Rounds after it take MORE_HUBS times as many hubs of a key as the one before,
    and as many as make KEY_PAIRS pairs, so small keys end in the third round and
    rounds grow with the logarithm of the ids that are like no other of their
    key. No two ids of a key that may be alike are left uncompared and in different
    components; no round compares ids of one component. Components of a round are
    stars to the next, which adds its links to them.

    From the second round on, only shingles found in several components count:
    they bound the sizes of the sets an id can be alike to (:func:`_reach`). Ids
    that no size is left for leave their keys, and hubs meet the sizes within
    their bounds and those of the other side. This too loses no link.
    """
    members, labels, tried, sets, reach = _members(nodes), None, None, None, None
    rounds = Rounds()
    prints = nodes.select("id", "size", "fp")
    hubs, central = 1, False
    while True:
        held = members.withColumn("root", F.col("id")) if labels is None else rounds.keep(members.join(labels, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
        still = rounds.keep(_undone(held))
        if (central or reach is not None) and not still.isEmpty():
            if sets is None:
                with modest_batches(docs.sparkSession):
                    sets = staged(shingle_sets(docs, still.select("id"), words, id_col, text_col), "sets")
            reach = rounds.keep(_reach(sets, still.select("id", "root").distinct(), similarity))
            still = rounds.keep(_undone(still.join(reach.select("id").distinct(), "id").select("key", "id", "root")))
        if still.isEmpty():
            if sets is not None:
                remove(sets)
            return nodes.select("id", F.col("id").alias("root")).limit(0) if labels is None else labels
        if central:
            picked = rounds.keep(_central(still, reach))
        else:
            place = F.row_number().over(W.partitionBy("key").orderBy("hub"))
            most = F.lit(hubs) if hubs == 1 else F.greatest(F.lit(hubs), F.floor(F.lit(KEY_PAIRS) / F.col("n")))
            outside = still.filter("root <> main").select("key", F.col("id").alias("hub"), F.col("root").alias("hub_root"), "n")
            picked = rounds.keep(outside.withColumn("_at", place).filter(F.col("_at") <= most).select("key", "hub", "hub_root"))
        met = still.join(picked, "key") if reach is None else _within_reach(still, picked, reach, similarity)
        near = _near_prints(_ordered(met.filter("root <> hub_root").select("id", "hub")), prints, similarity)
        near = staged(near if tried is None else near.join(tried, ["u", "v"], "left_anti"), "near")
        tried = near if tried is None else tried.union(near)
        if not near.isEmpty():
            compared = sets
            if sets is None:
                ids = near.select(F.col("u").alias("id")).union(near.select("v"))
                with modest_batches(docs.sparkSession):
                    compared = rounds.keep(shingle_sets(docs, ids, words, id_col, text_col))
            found = rounds.keep(alike(near, compared).filter(F.col("alike") >= similarity).select("u", "v"))
            if not found.isEmpty():
                labels = connected(found if labels is None else found.union(labels.select(F.col("id").alias("u"), F.col("root").alias("v")))).withColumnRenamed("node", "id")
        members = still.join(picked.withColumnRenamed("hub", "id"), ["key", "id"], "left_anti").select("key", "id")
        hubs, central = (1, True) if reach is None else (hubs * MORE_HUBS, False)
        rounds.turn()


def _undone(held: DataFrame) -> DataFrame:
    """Rows (key, id, root) of the keys whose ids are of several components, with the largest one's root and the key's number of ids."""
    sizes = held.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"))
    return held.join(main.filter("roots > 1").drop("roots"), "key")


def _reach(sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Rows (id, size, limit): a set's size, and the largest size of a set of another component of ``roots`` that it can be alike to.

    Two sets are alike if they share at least ``s / (1 + s)`` of the sum of their
    sizes. They share no more than a set has shingles found in several
    components, which leaves the other's size a limit; it has at least ``s``
    times the set's size. Sets for which no size is left are not returned.
    """
    parts = sets.join(roots, "id").select("id", "root", F.xxhash64("set").alias("name"), F.size("set").alias("size"), F.explode("set").alias("shingle"))
    common = parts.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("shingle")
    # shingles are many times what the planner takes them for, and must not be sent through the driver
    shared = parts.join(common.hint("merge"), "shingle").groupBy("id", "name", "size").agg(F.count("*").alias("shared"))
    limit = F.floor(F.col("shared") * ((1 + similarity) / similarity) + 1e-6) - F.col("size")
    return shared.select("id", "size", limit.alias("limit")).filter(F.col("limit") >= F.col("size") * similarity - 1e-6).distinct()


def _central(still: DataFrame, reach: DataFrame) -> DataFrame:
    """A hub for each key, of whichever component: the id with the largest share of shingles found in other components.

    Of texts made from one template it is the one with the fewest changes, which
    more of the others are like than are like each other.
    """
    share = reach.groupBy("id").agg(F.max(F.col("limit") / F.col("size")).alias("share"))
    first = F.min(F.struct((-F.col("share")).alias("rank"), F.col("id").alias("hub"), F.col("root").alias("hub_root")))
    return still.join(share, "id").groupBy("key").agg(first.alias("first")).select("key", "first.hub", "first.hub_root")


def _within_reach(still: DataFrame, picked: DataFrame, reach: DataFrame, similarity: float) -> DataFrame:
    """Ids of a key beside its hubs, where the size of either is within the reach of the other; met by classes of size."""
    filed = lambda size: F.floor(F.log(F.greatest(size, F.lit(1))) / math.log(SIZE_CLASS))
    others = still.join(reach, "id").withColumn("class", filed(F.col("size")))
    hubs = picked.join(reach.toDF("hub", "hub_size", "hub_limit"), "hub")
    hubs = hubs.withColumn("class", F.explode(F.sequence(filed(F.ceil(F.col("hub_size") * similarity - 1e-6)), filed(F.col("hub_limit")))))
    return others.join(hubs, ["key", "class"]).filter("size <= hub_limit and hub_size <= limit")


def _ordered(pairs: DataFrame) -> DataFrame:
    u, v = (F.col(c) for c in pairs.columns)
    return pairs.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()


def _near_prints(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs that sizes and long fingerprints leave possible.

    The smaller set has at least ``similarity`` times the shingles of the larger.
    Fingerprint bits of two sets with a share ``s`` of equal shingles are signs
    of two sums with a correlation of at least ``2s / (1 + s)``, so a bit differs
    with a probability of at most ``arccos(2s / (1 + s)) / pi``. The limit lies
    MARGIN standard deviations above that; small sets pass untested.
    """
    one, two = (prints.select(F.col("id").alias(c), F.col("size").alias(f"_n{c}"), F.col("fp").alias(f"_f{c}")) for c in "uv")
    both = pairs.join(two, "v").join(one, "u")  # hubs are mostly the smaller id: their join is followed by another, so it can be split
    less, more = F.least("_nu", "_nv"), F.greatest("_nu", "_nv")
    bits = F.aggregate(F.zip_with("_fu", "_fv", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * F.size("_fu")
    close = (less < COARSE) | (bits <= share * n + MARGIN * F.sqrt(n * (share * (1 - share))))
    return both.filter((less >= similarity * more) & close).select("u", "v").distinct()


def drop_near(docs: DataFrame, words: int = 5, similarity: float = 0.8, longs: int = 6, id_col: str = "doc_id", text_col: str = "text", bands: int = 16, rows: int = 5) -> DataFrame:
    """One document of each group of similar texts, the one with the smallest id, with all its columns.

    Texts are similar when the Jaccard similarity of their sets of shingles of
    ``words`` words is at least ``similarity`` (see :func:`similar_roots`);
    groups are connected components. Fingerprints of ``64 * longs`` bits and
    ``bands`` keys of ``rows`` lowest hashes find the pairs to compare. Texts
    without words form one group. The id names a document: rows that repeat an
    id stay or go together. Rows with a null id stay. An empty table stays empty.
    Columns may have any name.
    """
    docs, held, back = sheltered(docs)
    id_col, text_col = held[id_col], held[text_col]
    with modest_batches(docs.sparkSession):
        marked = cut(sketches(docs, words, longs, bands, rows, id_col, text_col))
    nodes = cut(marked.groupBy("digest", "size", "fp", "bands").agg(F.min("doc_id").alias("id")))
    roots = similar_roots(nodes, docs, similarity, words, id_col, text_col)
    lead = nodes.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("_lead"))
    gone = marked.select("doc_id", "digest").join(lead, "digest").filter("doc_id <> _lead").select(F.col("doc_id").alias("_op10_gone")).distinct()
    gone = cut(gone)
    maybe, surely = sieve(docs, id_col, gone, "_op10_gone")
    # an anti join would be moved below the sieve, and all rows shuffled
    left = maybe.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("_op10_gone"), "left").filter("_op10_gone is null")
    return surely.select(*back).union(left.select(*back))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
