"""Spark-native analytics for network packet captures and detection events."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
