"""Spark-native business-entity intelligence and training-data engine."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
