from .messages import (  # noqa: F401
    FILES_PER_BATCH,
    messages_from_records,
    read_messages,
    stream_messages,
)
from .stores import (  # noqa: F401
    append_partitioned,
    copy_series,
    read_cached_series,
    read_job_list,
    read_resources,
    read_series,
)
from .tables import dimension, fixed_table  # noqa: F401
