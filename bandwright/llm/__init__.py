"""Operators for training-data pipelines. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them: a cluster need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
