"""Spark-native analytics for multi-channel time series."""

import sys

from pyspark import cloudpickle

# functions travel with the job, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
