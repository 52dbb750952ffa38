"""quern: columnar analytics over Parquet tables, written for Spark's optimizer."""

__version__ = "0.1.0"
