"""Column selection, renaming, repairs and NULL handling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.functions.text import if_else

_KINDS = {
    "numeric": T.NumericType,
    "string": T.StringType,
    "boolean": T.BooleanType,
    "date": T.DateType,
    "timestamp": (T.TimestampType, T.TimestampNTZType),
    "array": T.ArrayType,
}


def reorder(df: DataFrame, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """Move columns to the front or the back; the rest keep their order."""
    middle = [c for c in df.columns if c not in first and c not in last]
    return df.select(*first, *middle, *last)


def place(df: DataFrame, name: str, before: str | None = None, after: str | None = None) -> DataFrame:
    """Move one column directly before or after another."""
    rest = [c for c in df.columns if c != name]
    at = rest.index(before) if before else rest.index(after) + 1
    return df.select(*rest[:at], name, *rest[at:])


def cols_like(
    df: DataFrame, prefix: str | None = None, contains: str | None = None, regex: str | None = None, negate: bool = False
) -> list[str]:
    """Column names matching every given test, case-insensitively as column names are."""

    def hit(c: str) -> bool:
        low = c.lower()
        return (
            (prefix is None or low.startswith(prefix.lower()))
            and (contains is None or contains.lower() in low)
            and (regex is None or re.search(regex, c, re.IGNORECASE) is not None)
        )

    return [c for c in df.columns if hit(c) != negate]


def cols_of_type(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _KINDS[kind])]


def rename_like(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Rewrite the first match of a pattern in every column name."""
    return df.toDF(*[re.sub(pattern, replacement, c, count=1) for c in df.columns])


def rename_at(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Rename by 0-based position."""
    return df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns)])


def _snake(name: str) -> str:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip().replace("'", "").replace("%", "_percent_").replace("#", "_number_"))
    snake = re.sub(r"[^0-9a-z]+", "_", spaced.lower()).strip("_") or "x"
    return f"x{snake}" if snake[0].isdigit() else snake


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case names; a leading digit gets an ``x``, repeats get ``_2``, ``_3`` …"""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = _snake(c)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def across(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to many columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def mutate(df: DataFrame, **steps: Column) -> DataFrame:
    """Add columns one after another, so that each may use the ones before it."""
    for name, expression in steps.items():
        df = df.withColumn(name, expression)
    return df


def in_bbox(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows strictly inside (south, west, north, east); plain comparisons, so they reach the scan."""
    south, west, north, east = box
    return df.filter((F.col(lat) > south) & (F.col(lat) < north) & (F.col(lon) > west) & (F.col(lon) < east))


def fill_with_agg(df: DataFrame, col: str, agg: Column) -> DataFrame:
    """Fill NULLs of a column with one statistic of the whole table."""
    return df.withColumn(col, F.coalesce(F.col(col), df.agg(agg.alias("v")).scalar()))


def drop_na(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL (or NaN) in any of the columns."""
    return df.dropna(how="any", subset=list(cols) if cols else None)


def fix_sign(df: DataFrame, col: str) -> DataFrame:
    """A western longitude entered without its sign gets it back."""
    return df.withColumn(col, if_else(F.col(col) > 0, -F.col(col), F.col(col)))


def unswap(df: DataFrame, a: str, b: str, condition: Column) -> DataFrame:
    """Exchange two columns where the condition holds; both sides read the values from before the exchange."""
    swapped = F.coalesce(condition, F.lit(False))
    return df.withColumns({a: F.when(swapped, F.col(b)).otherwise(F.col(a)), b: F.when(swapped, F.col(a)).otherwise(F.col(b))})


def with_levels(df: DataFrame, col: str, levels: Sequence[str], missing: str = "missing") -> DataFrame:
    """A categorical column with a level for NULL and its 1-based position in ``<col>_pos`` (unlisted values go last)."""
    value = F.coalesce(F.col(col), F.lit(missing))
    known = list(levels) + ([missing] if missing not in levels else [])
    position = F.array_position(F.array(*[F.lit(v) for v in known]), value).cast("int")
    return df.withColumns({col: value, f"{col}_pos": F.when(position > 0, position).otherwise(F.lit(len(known) + 1))})


def level_counts(df: DataFrame, col: str, levels: Sequence[str], missing: str = "missing") -> DataFrame:
    """Rows per level in level order; levels that do not occur show 0."""
    known = list(levels) + ([missing] if missing not in levels else [])
    counts = df.groupBy(F.coalesce(F.col(col), F.lit(missing)).alias(col)).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    table = spark.createDataFrame([(v, i + 1) for i, v in enumerate(known)], f"`{col}` string, pos int")
    return table.join(counts, col, "left").select(col, "pos", F.coalesce("n", F.lit(0)).alias("n"))


def sample_one(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One repeatable arbitrary row: the smallest salted hash of the key."""
    salted = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(salted, key).limit(1)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()
