"""annospark: annotation-enrichment analytics expressed as Spark DataFrame jobs.

Public functions take and return DataFrames; nothing is collected to the driver
except loop-termination counts of the level-bounded graph iterations.
"""

from annospark.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
