"""Text cleaning: first-match replacement, censored laboratory values, labels, three-valued logic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def if_else(condition: Column, yes, no) -> Column:
    """Three-valued choice: an unknown condition gives NULL, not the else branch."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(condition, lift(yes)).when(~condition, lift(no))


def is_in(x, values: Iterable) -> Column:
    """Membership that is false, not NULL, for NULL."""
    return F.coalesce(_col(x).isin(list(values)), F.lit(False))


def replace_first(x, pattern: str, replacement: str) -> Column:
    """Replace the first match only; the pattern must not contain capturing groups."""
    return F.regexp_replace(_col(x), f"(?s)^(.*?)(?:{pattern})", "$1" + replacement.replace("$", "\\$"))


def remove_first(x, pattern: str) -> Column:
    return replace_first(x, pattern, "")


def extract(x, pattern: str) -> Column:
    """First match of the whole pattern, NULL when nothing matches."""
    x = _col(x)
    return F.when(x.rlike(pattern), F.regexp_extract(x, f"({pattern})", 1))


# a bracketed remark may stand before or after the value
_REMARK = r"(?:\([^)]*\))?"
_BELOW = rf"^\s*{_REMARK}\s*(?:<\s*10|[Tt][Rr][Aa][Cc][Ee])\s*(?:\(.*\))?\s*$"
_DRESSING = rf"^\s*{_REMARK}\s*>|\(.*\)"


def parse_censored(x) -> Column:
    """Laboratory text to a number: below detection and traces are 0, ``>`` and bracketed remarks are dropped, other text is NULL."""
    x = _col(x)
    return F.when(x.rlike(_BELOW), F.lit(0.0)).otherwise(F.regexp_replace(x, _DRESSING, "").try_cast("double"))


def censor_flag(x) -> Column:
    """Why a value is not exact: ``<``, ``>``, ``trace`` or NULL."""
    mark = F.lower(F.regexp_extract(_col(x), rf"^\s*{_REMARK}\s*([<>]|[Tt][Rr][Aa][Cc][Ee]\b)", 1))
    return F.when(mark != "", mark)


def thousands(x) -> Column:
    """Rounded to a whole number with thousands separators."""
    return F.format_number(F.round(_col(x)), 0)


def label_text(template: str, *cols) -> Column:
    """Label assembled from columns with a printf template."""
    return F.format_string(template, *[_col(c) for c in cols])
