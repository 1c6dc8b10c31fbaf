"""packloom: a PySpark-native engine for language-model corpus preparation."""

import sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
