"""Spatial analytics on plain Spark DataFrames: vector layers, rasters and history tables."""

import sys

from pyspark import cloudpickle

# Python tasks carry the package's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
