"""Readers that bring published files to tidy tables, and the sinks."""
