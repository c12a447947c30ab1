"""Versioned document tables kept in step with a declared state, on Spark.

``functions``  column expressions (JSON comparison, names, text, meta)
``sources``    resource trees, stored tables, changelog, search and lookup
``operators``  DataFrame to DataFrame steps (latest entry, overlay, upsert ...)
``plans``      whole jobs built from the operators (change set, reindex ...)
"""
