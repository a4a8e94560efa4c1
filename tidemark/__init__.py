"""Competitive-intelligence analytics as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the task itself, so no archive has to be shipped to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
