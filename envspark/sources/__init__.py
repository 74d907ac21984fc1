"""Readers, writers and landing-file shapes."""

from envspark.sources.landing import (  # noqa: F401
    calendar_to_events,
    explode_predictions,
    normalise_sheet,
    request_grid,
)
from envspark.sources.tables import export_csv, read_csv, read_json, read_table, write_table  # noqa: F401
