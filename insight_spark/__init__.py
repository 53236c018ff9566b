"""insight_spark: business-data analytics as PySpark DataFrame jobs."""

from insight_spark.session import build_session, load_table, shared_dir

__all__ = ["build_session", "load_table", "shared_dir"]
