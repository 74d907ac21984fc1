"""Operator 11, vector code compression: part codebooks, searched by slicing sorted coordinates and intersecting bitmasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import cut, table

#: Integer components beyond this would overflow squared distances in 64 bits.
LARGEST = 1 << 27

#: Vectors whose parts are searched at a time; bounds a worker's memory and changes no result.
AT_ONCE = 1 << 13

#: Coordinates in which a near entry is looked up for the initial radius.
PROBES = 2


class Slices:
    """The entries of a codebook, sorted in every dimension.

    ``masks[d][i]`` has the bits of the first ``i`` entries in the order of
    dimension ``d``; two of them give the entries of any range by one exclusive
    or, and the ranges of all dimensions are intersected by AND. Entries beyond
    64 take further words.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        k, dims = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.order, self.sorted = order.T, np.take_along_axis(entries, order, 0).T.copy()
        self.masks = np.zeros((dims, k + 1, -(-k // 64)), np.uint64)
        for d in range(dims):
            for i, e in enumerate(self.order[d].tolist()):
                self.masks[d, i + 1] = self.masks[d, i]
                self.masks[d, i + 1, e // 64] |= np.uint64(1 << e % 64)
        self.probes = np.argsort(self.sorted[:, 0] - self.sorted[:, -1], kind="stable")[:PROBES]

    def radius(self, points: np.ndarray) -> np.ndarray:
        """A whole number no less than the floor of the distance to the nearest entry: that to an entry on either side of the point in a widely spread dimension."""
        found = np.full(len(points), np.iinfo(np.int64).max)
        for d in self.probes:
            above = np.searchsorted(self.sorted[d], points[:, d])
            for beside in (np.maximum(above - 1, 0), np.minimum(above, len(self.entries) - 1)):
                found = np.minimum(found, ((points - self.entries[self.order[d][beside]]) ** 2).sum(axis=1))
        root = np.sqrt(found.astype(np.float64)).astype(np.int64)
        return root + ((root + 1) ** 2 <= found)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ from each point by no more than its radius in every dimension; the nearest is one of them."""
        radius = self.radius(points)
        held = np.full((len(points), self.masks.shape[2]), ~np.uint64(0))
        for d, values in enumerate(self.sorted):
            low = np.searchsorted(values, points[:, d] - radius, "left")
            high = np.searchsorted(values, points[:, d] + radius, "right")
            held &= self.masks[d, high] ^ self.masks[d, low]
        return held

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equals, and the squared distance; only candidates are measured."""
        held = self.candidates(points)
        k = len(self.entries)
        bits = np.arange(k)
        rows, found = np.nonzero((held[:, bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1))
        distance = np.full((len(points), k), np.iinfo(np.int64).max)
        distance[rows, found] = ((points[rows] - self.entries[found]) ** 2).sum(axis=1)
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(points)), best]


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The rows whose vector is not null, not empty and holds finite components only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(F.col(vec_col), bad))


def _integers(column: pa.Array, scale: int, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integer vectors) of a column of vectors, some rows at a time."""
    for a in range(0, len(column), AT_ONCE):
        flat = column.slice(a, AT_ONCE).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        whole = np.floor(flat * scale)
        if len(whole) and np.abs(whole).max() >= LARGEST:
            raise ValueError(f"a component times {scale} is beyond {LARGEST}: choose a smaller scale")
        yield a, whole.astype(np.int64).reshape(-1, dims)


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int, id_col: str, vec_col: str) -> np.ndarray | None:
    """The parts of the vectors of smallest id, as (part, entry, position); equal ids by their components. None of an empty table."""
    first = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    dims = len(first[0].v)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    own = pa.array([r.v for r in first if len(r.v) == dims], pa.list_(pa.float64()))
    whole = np.concatenate([x for _, x in _integers(own, scale, dims)])
    return whole.reshape(len(whole), parts, dims // parts).transpose(1, 0, 2)


def _part_sums(rows: DataFrame, books: np.ndarray, scale: int, vec_col: str) -> DataFrame:
    """Rows (part, entry, n, s0, s1, ...): how many parts each entry is nearest to, and the sums of their components. A task sends one row for each entry at most."""
    parts, k, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for _, whole in _integers(batch.column(0), scale, parts * width):
                for p, own in enumerate(slices):
                    points = whole[:, p * width : (p + 1) * width]
                    entry, _ = own.nearest(points)
                    order = np.argsort(entry, kind="stable")
                    used, at, count = np.unique(entry[order], return_index=True, return_counts=True)
                    n[p, used] += count
                    sums[p, used] += np.add.reduceat(points[order], at, axis=0)
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part.astype(np.int32), entry.astype(np.int32), n[part, entry], *sums[part, entry].T)], ["part", "entry", "n", *names])

    names = [f"s{j}" for j in range(width)]
    found = rows.select(F.col(vec_col).cast("array<double>")).mapInArrow(add, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])


def train_codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray | None:
    """Codebooks as integers (part, entry, position), fitted on every row; see :func:`encode`.

    The driver gets one row of sums for each part and entry, whatever the
    number of vectors. Unused entries stay as they are; means are rounded down.
    """
    books = first_codebooks(usable(vectors, vec_col), parts, entries, scale, id_col, vec_col)
    if books is None:
        return None
    rows = _fitting(vectors, books, vec_col)
    for _ in range(rounds):
        books = books.copy()
        for r in _part_sums(rows, books, scale, vec_col).collect():
            books[r.part, r.entry] = [s // r.n for s in r[3:]]
    return books


def _fitting(vectors: DataFrame, books: np.ndarray, vec_col: str) -> DataFrame:
    return usable(vectors, vec_col).filter(F.size(vec_col) == books.shape[0] * books.shape[2])


def encode(vectors: DataFrame, books: np.ndarray | None, scale: int = 4096, vec_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Columns ``keep`` with code, two hexadecimal digits for each part's entry, and error, the squared distance to what the code stands for.

    Components become ``floor(scale * x)``. Vectors that are null, empty, hold
    null or non-finite components, or have another length than the vector of the
    smallest id are left out. Equal distances go to the lower entry. Repeated
    rows are coded each. Other columns are not read, whatever their names. An
    empty table gives no rows.
    """
    kept = vectors.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", code string, error long"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    parts, k, width = books.shape
    if k > 256:
        raise ValueError("two hexadecimal digits name 256 entries at most")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            codes, errors = [], []
            for _, whole in _integers(batch.column(len(keep)), scale, parts * width):
                best, distance = zip(*(own.nearest(whole[:, p * width : (p + 1) * width]) for p, own in enumerate(slices)))
                codes += [x.tobytes().hex() for x in np.stack(best, 1).astype(np.uint8)]
                errors.append(np.sum(distance, axis=0))
            if codes:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(codes), pa.array(np.concatenate(errors))], [*keep, "code", "error"])

    rows = _fitting(vectors, books, vec_col).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vec_col}`").cast("array<double>").alias("_vector"))
    return rows.mapInArrow(code, schema)


def decode(codes: list[str], books: np.ndarray, scale: int = 4096) -> np.ndarray:
    """The vectors that codes stand for, one row each."""
    entry = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(-1, books.shape[0])
    return books[np.arange(books.shape[0]), entry].reshape(len(codes), -1) / scale


def codebooks_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = train_codebooks(vectors)
    coded = cut(encode(vectors, books, keep=("vec_id", "label")))
    by_label = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Assignment and means of every round as common table expressions."""
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c AS MATERIALIZED (SELECT r, (j - 1) // (len(v) // {parts}) AS p, (j - 1) % (len(v) // {parts}) AS i, v[j] AS x FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS j FROM k))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, x FROM c WHERE r <= {entries})",
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM c JOIN b{t} b ON c.p = b.p AND c.i = b.i GROUP BY c.r, c.p, b.e) GROUP BY r, p)""")
        if t < rounds:
            steps.append(f"""b{t + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, CASE WHEN n IS NULL THEN b.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM b{t} b LEFT JOIN (SELECT a.p, a.e, c.i, sum(c.x)::BIGINT AS s, count(*) AS n FROM a{t} a JOIN c ON c.r = a.r AND c.p = a.p GROUP BY a.p, a.e, c.i) m ON m.p = b.p AND m.e = b.e AND m.i = b.i)""")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o ON o.r = k.r, h"


SQL = _sql()
