"""Training-data operators over DataFrames of documents. Nothing else in the library imports this subpackage."""
