"""Sinks: the symbol index on Parquet, replace/delete by file, versions, diagnostics."""
