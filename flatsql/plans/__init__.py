"""The query language: text to a query object to a DataFrame."""
