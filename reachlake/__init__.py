"""Travel-time accessibility analytics and training-data jobs on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to Python workers by value, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
