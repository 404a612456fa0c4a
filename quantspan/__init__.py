"""quantspan - risk, validation and audit analytics over market tables, written as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python steps travel to the executors by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
