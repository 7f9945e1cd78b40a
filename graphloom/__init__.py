"""Spark-native analytics over software knowledge graphs.

Functions that run in Python workers are pickled by value, so executors need no copy of the
package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
