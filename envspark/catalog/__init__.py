"""Every registered query; importing the modules fills the registry."""

from envspark.catalog import (  # noqa: F401
    from_aggregate,
    from_columns,
    from_joins,
    from_models,
    from_plans,
    from_project,
    from_sources,
    from_windows,
)
from envspark.catalog.base import ORACLES, QUERIES  # noqa: F401
