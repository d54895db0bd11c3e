"""sliceframe: a PySpark-native engine for collections of ordered, grouped records.

Functions of this package travel to executors by value, so that a cluster
whose workers have only Spark and Python installed can run every operator.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
