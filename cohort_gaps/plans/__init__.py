"""Composed operators: from base tables to benchmarks, gaps, rankings, residuals, trends and flat tables."""
