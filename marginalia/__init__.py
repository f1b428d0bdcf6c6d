"""Spark-first analytics over catalogs and long-form manuscripts."""
