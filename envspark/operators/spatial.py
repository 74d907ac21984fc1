"""Nearest station by great-circle distance, exact and without a cross product.

Stations are laid out on nested latitude / longitude grids. Each site starts
from the few occupied cells of a coarse grid and descends: a cell's
representative station bounds the answer from above, the distance to the
bounding box of its stations bounds it from below, and cells that cannot hold
the nearest station are dropped before the next, finer grid is joined. A dense
cluster of stations is thus opened only along its near side, and equal
coordinates are looked up once on either side.

Bounds are taken between points of the unit sphere, where the box distance is
three subtractions and needs no care at the poles or the date line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark.functions.geo import EARTH_RADIUS_KM, great_circle_km, unit_vector

LEVELS = 9
TOP_DEGREES = 22.5  # 9 x 17 cells cover the sphere, which bounds the first step
START_CELLS = 64
LEAF_STATIONS = 64
SLACK = 2e-6 / EARTH_RADIUS_KM  # two millimetres: distances that round alike are all kept for the tie-break

_AXES = ("x", "y", "z")


def _cell(lat: Column, lon: Column, level: int) -> Column:
    size = TOP_DEGREES / 4**level
    return F.floor((lat + 90) / size) * F.lit(1 << 32) + F.floor((lon + 180) / size)


def _boxes(stations: DataFrame, level: int) -> DataFrame:
    """One row per occupied cell: bounding box of its stations and one of them."""
    lat, lon = F.col("_slat"), F.col("_slon")
    keys = [_cell(lat, lon, level).alias("_cell")]
    if level:
        keys.append(_cell(lat, lon, level - 1).alias("_parent"))
    sides = [f(f"_s{a}").alias(f"_{n}{a}") for a in _AXES for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return stations.groupBy(*keys).agg(*sides, F.min(F.struct(*[F.col(f"_s{a}") for a in _AXES])).alias("_rep"))


def _square(x: Column) -> Column:
    return x * x


def _chord(rep) -> Column:
    """Straight-line distance to a station given as a struct."""
    return F.sqrt(sum((_square(F.col(f"_{a}") - rep[f"_s{a}"]) for a in _AXES), F.lit(0.0)))


def _chord_to_box() -> Column:
    sides = [F.greatest(F.col(f"_lo{a}") - F.col(f"_{a}"), F.col(f"_{a}") - F.col(f"_hi{a}"), F.lit(0.0)) for a in _AXES]
    return F.sqrt(sum((_square(s) for s in sides), F.lit(0.0)))


def _grid_levels(stations: DataFrame) -> tuple[int, int]:
    """First level to start from and the level whose cells hold few enough stations; reads one row per level."""
    cells = F.array(*[F.struct(F.lit(i).alias("level"), _cell(F.col("_slat"), F.col("_slon"), i).alias("cell")) for i in range(LEVELS)])
    stats = (
        stations.select(F.inline(cells))
        .groupBy("level", "cell")
        .count()
        .groupBy("level")
        .agg(F.count(F.lit(1)).alias("occupied"), F.max("count").alias("fullest"))
        .collect()
    )
    by_level = {r["level"]: r for r in stats}
    if not by_level:
        return 0, 0
    start = max([i for i in range(LEVELS) if by_level[i]["occupied"] <= START_CELLS], default=0)
    leaf = next((i for i in range(start, LEVELS) if by_level[i]["fullest"] <= LEAF_STATIONS), LEVELS - 1)
    return start, leaf


def nearest_to_spots(
    spots: DataFrame, right: DataFrame, label: str, id: str = "id", right_lat: str = "latitude", right_lon: str = "longitude"
) -> DataFrame:
    """(lat, lon, ``<label>_id``, ``<label>_dist_km``) for a table of distinct coordinates.

    The two columns of ``spots`` are latitude and longitude; the lowest id wins
    among equally near stations.
    """
    lat, lon = spots.columns
    stations = (
        right.select(F.col(id).alias("_id"), F.col(right_lat).cast("double").alias("_slat"), F.col(right_lon).cast("double").alias("_slon"))
        .dropna()
        .groupBy("_slat", "_slon")
        .agg(F.min("_id").alias("_id"))
    )
    placed = stations.select("*", *[v.alias(f"_s{a}") for a, v in zip(_AXES, unit_vector("_slat", "_slon"))])
    start, leaf = _grid_levels(stations)
    here = [lat, lon, *[f"_{a}" for a in _AXES]]
    near_enough = _chord_to_box() <= F.col("_best") + SLACK

    # at most 9 x 17 boxes, held in every row as one array; each site's bound is known before they are spread to rows
    box = ["_cell", "_rep", *[f"_{n}{a}" for a in _AXES for n in ("lo", "hi")]]
    first = _boxes(placed, start).agg(F.collect_list(F.struct(*box))).scalar()
    open_cells = (
        spots.select(lat, lon, *[v.alias(f"_{a}") for a, v in zip(_AXES, unit_vector(lat, lon))])
        .withColumn("_open", first)
        .withColumn("_best", F.array_min(F.transform("_open", lambda b: _chord(b["_rep"]))))
        .select(*here, "_best", F.inline("_open"))
        .filter(near_enough)
        .select(*here, "_cell", "_best")
    )
    per_spot = Window.partitionBy(lat, lon)
    for level in range(start + 1, leaf + 1):
        finer = open_cells.withColumnRenamed("_cell", "_parent").join(_boxes(placed, level), "_parent")
        reach = F.min(_chord(F.col("_rep"))).over(per_spot)
        open_cells = finer.withColumn("_best", F.least("_best", reach)).filter(near_enough).select(*here, "_cell", "_best")
    homes = stations.withColumn("_cell", _cell(F.col("_slat"), F.col("_slon"), leaf))
    return (
        open_cells.join(homes, "_cell")
        .select(lat, lon, "_id", great_circle_km(lat, lon, "_slat", "_slon").alias("_km"))
        .groupBy(lat, lon)
        .agg(F.min_by(F.struct("_id", "_km"), F.struct(F.round("_km", 6), "_id")).alias("_near"))
        .select(lat, lon, F.col("_near._id").alias(f"{label}_id"), F.col("_near._km").alias(f"{label}_dist_km"))
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    label: str,
    id: str = "id",
    lat: str = "latitude",
    lon: str = "longitude",
    right_lat: str | None = None,
    right_lon: str | None = None,
    include_dist: bool = True,
) -> DataFrame:
    """Add ``<label>_id`` and ``<label>_dist_km``: one station per row, the lowest id among equally near ones.

    Rows without coordinates get NULL; stations without coordinates are never chosen.
    """
    spots = left.select(lat, lon).dropna().distinct()
    found = nearest_to_spots(spots, right, label, id, right_lat or lat, right_lon or lon)
    if not include_dist:
        found = found.drop(f"{label}_dist_km")
    return left.join(found, [lat, lon], "left").select(*left.columns, *[c for c in found.columns if c not in (lat, lon)])
