"""Operators of a training-data pipeline; nothing else in the library imports this package.

Their Python functions travel to executors by value, so executors need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
