"""A Spark-native engine for append-only, bitemporal belief data.

An event log is the only ground truth; claim versions, support graphs, governance tables and every analytic are
DataFrames derived from it.  See README.md for the map of modules.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel with the job, so executors need not have this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
