"""Spark-native operators for gridded evidence: cell, point, tile and document tables."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Kernels travel to the executors with their code, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])
