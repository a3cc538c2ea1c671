"""tidewell — keyed feature tables with few labels, prepared, learned and analysed on Spark.

Every operator is DataFrame-in / DataFrame-out.  Fitted statistics are small
DataFrames (one row, or one row per class / feature); models are ``pyspark.ml``.
"""

from tidewell.spec import Spec

__all__ = ["Spec"]
__version__ = "0.1.0"
