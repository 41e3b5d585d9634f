"""Replication of application data between two environments, expressed as Spark DataFrame jobs.

Every public operator takes and returns DataFrames. See the README for the map from operator to module.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their own code, so only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
