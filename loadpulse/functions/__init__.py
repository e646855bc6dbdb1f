from .codes import (  # noqa: F401
    db_key,
    intensity_multiplier,
    lookup,
    parse_db_key,
    pattern_key,
    resource_name,
    size_from_name,
    size_label,
    type_label,
)
from .timing import (  # noqa: F401
    failure_flag,
    failure_percent,
    latency,
    prototype_latency,
    quotient_or_nan,
    split_key,
    window_timestamp,
    with_timing_fallback,
)
