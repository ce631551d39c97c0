"""A PySpark-native engine for approximate sequence search and interval analytics.

Functions that run in Python workers are shipped by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
