"""Network-flow analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel by value: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
