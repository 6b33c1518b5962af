"""ledgerline: table reconciliation and catalog analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames; nothing is collected to
the driver except schema metadata (column lists) and tiny one-row results that
callers explicitly ask for.
"""

from ledgerline.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
