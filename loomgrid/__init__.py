"""A PySpark-native engine for sparse count matrices and neighbour statistics."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
