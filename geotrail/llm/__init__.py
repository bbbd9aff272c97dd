"""Operators of a training-data pipeline (corpus cleaning, de-duplication,
mixing, packing, search). Nothing else in the library imports this package.

The functions that run inside Spark's Python workers travel by value, so
executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
