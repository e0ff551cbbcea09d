class QueryError(ValueError):
    """A query that cannot be parsed or resolved."""
