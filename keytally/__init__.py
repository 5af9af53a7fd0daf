"""Keyed running state on Spark: count, snapshot, edit, compare, resume."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
