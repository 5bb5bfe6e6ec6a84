"""Data-pipeline operators on Spark DataFrames, for bounded tables and streams."""

import sys

from pyspark import cloudpickle

# Functions and classes that run in tasks travel with the task, so executors need no copy of the package.
# Such functions must not refer to modules of the package, only to their functions, classes and values.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
