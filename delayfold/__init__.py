"""Delayed-message scheduling as Spark jobs: decode, fold, fire, publish, observe."""

import sys

from pyspark import cloudpickle

# The Python functions travel to the executors by value; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
