from .jobs import (  # noqa: F401
    ElementsLost,
    heartbeat,
    read_latest_series,
    read_open_windows,
    read_resource_state,
    read_split,
    read_split_counts,
    slowest_input,
    start_lease_sweep,
    start_message_sink,
    start_parse_with_quarantine,
    start_resource_state,
    start_series_sink,
    start_series_upserts,
    stream_batched_messages,
    stream_sql_windowed_latency,
    stream_windowed_latency_failure,
    union_of_topics,
)
