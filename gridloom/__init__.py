"""Spark-native analysis of messy tables: intake, cleaning, profiling, statistics and findings."""

import sys

from pyspark import cloudpickle

# Small helper functions travel to the executors with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
