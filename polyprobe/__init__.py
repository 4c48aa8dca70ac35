"""Multilingual model-evaluation analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so executors need numpy
# and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
