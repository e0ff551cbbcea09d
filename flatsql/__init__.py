"""SQL over flat files on Spark: text is parsed to a query, the query compiled to DataFrame expressions."""

from flatsql.api import Engine, query, query_csv, query_df, query_tuples
from flatsql.errors import QueryError

__version__ = "0.1.0"
__all__ = ["Engine", "QueryError", "__version__", "query", "query_csv", "query_df", "query_tuples"]
