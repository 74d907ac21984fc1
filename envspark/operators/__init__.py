"""DataFrame → DataFrame operators."""

from envspark.operators.aggregate import (
    with_place,  # noqa: F401
    box_stats,
    corr_matrix,
    first_last,
    histogram,
    null_profile,
    profile,
    profile_text,
    quartiles,
    reference_agreement,
    site_summary,
    top_k,
    top_n_by,
    trend,
    whiskers,
    with_totals,
    yearly_trend,
)
from envspark.operators.asof import asof_backward, asof_forward, asof_with_fallback, nearest_value, next_value  # noqa: F401
from envspark.operators.bins import bin_equal, label_bins  # noqa: F401
from envspark.operators.joins import (  # noqa: F401
    cohort,
    compare_assignments,
    fill_from_default,
    join_renamed,
    left_join_with_default,
    natural_join,
)
from envspark.operators.spatial import nearest, nearest_to_spots  # noqa: F401
from envspark.operators.project import (  # noqa: F401
    across,
    clean_names,
    cols_like,
    cols_of_type,
    distinct_values,
    drop_na,
    fill_with_agg,
    fix_sign,
    in_bbox,
    level_counts,
    mutate,
    place,
    rename_at,
    rename_like,
    reorder,
    sample_one,
    unswap,
    with_levels,
)
from envspark.operators.quantiles import group_median, group_quantiles  # noqa: F401
from envspark.operators.reshape import (  # noqa: F401
    append_distinct,
    densify,
    expand_days_back,
    first_by,
    nest,
    pivot,
    separate,
    tagged_union,
    union_distinct,
    unnest,
    unpivot_year,
)
from envspark.operators.windows import (  # noqa: F401
    group_extreme,
    impute_group_mean,
    lag_sum,
    phase_features,
    roll_sum,
    section_fill,
    share_within,
)
