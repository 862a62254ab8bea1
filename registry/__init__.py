"""Every operator as a query over the given tables, each with its equivalent in SQL."""

from registry import (  # noqa: F401
    chunk_queries,
    function_queries,
    maintenance_queries,
    search_queries,
    stream_queries,
    vector_queries,
)
from registry.base import QUERIES, SQL  # noqa: F401
