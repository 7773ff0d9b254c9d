"""Trend-topic analytics on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

from trendspark.config import Settings

# Functions travel to the executors by value, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
