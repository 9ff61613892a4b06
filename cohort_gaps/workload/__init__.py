"""The operators applied to the shared test tables, with a SQL twin for each query."""
