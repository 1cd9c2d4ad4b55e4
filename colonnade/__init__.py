"""colonnade: columnar analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors go there by value, so that only the driver needs this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
