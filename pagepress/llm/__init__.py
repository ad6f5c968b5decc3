"""Operators for training-data pipelines. Nothing else in the library imports this package.

Functions of this package travel to the executors by value, so that these need no copy of it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
