"""Tidemark: a Spark-first analytics engine for multi-asset panels."""

import sys

from pyspark import cloudpickle

# Python kernels travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
