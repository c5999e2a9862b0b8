"""Spark-native analytics over fact tables of a code base."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel whole, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
