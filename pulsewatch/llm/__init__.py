"""Operators for training-data pipelines. Nothing outside this package imports it.

Worker code is sent to the executors by value, so they need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
