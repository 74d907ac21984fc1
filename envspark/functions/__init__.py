"""Column → Column functions; all of them compile to built-in Spark expressions."""

from envspark.functions.geo import great_circle_km, unit_vector  # noqa: F401
from envspark.functions.measures import (  # noqa: F401
    annualised,
    bin_index,
    c_to_f,
    compass16,
    current_index,
    cut,
    direction,
    finite,
    log_capped,
    mid_tenths,
    mm_to_in,
    rolling_sum,
    row_max,
    row_sum,
    season_index,
    share,
)
from envspark.functions.text import (  # noqa: F401
    censor_flag,
    extract,
    if_else,
    is_in,
    label_text,
    parse_censored,
    remove_first,
    replace_first,
    thousands,
)
from envspark.functions.times import (  # noqa: F401
    at_second,
    at_time,
    day_name,
    hms_text,
    hours_between,
    parse_ts,
    position,
    seconds_of_day,
)
