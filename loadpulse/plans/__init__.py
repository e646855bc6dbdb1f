from . import ingest_queries, series_queries, workload_queries  # noqa: F401
from .registry import QUERIES, checks, run  # noqa: F401


def all_queries() -> list[str]:
    return list(QUERIES)
