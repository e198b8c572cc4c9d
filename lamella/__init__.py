"""Spark-native analytics engine for board design data and the tables around it."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
