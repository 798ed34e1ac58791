"""credence: corpus-scale content-credibility scoring on Spark DataFrames."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
