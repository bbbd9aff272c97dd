"""geotrail: Spark-native operators for geo-tagged social posts.

Cleaning of per-user trajectories, country mobility statistics, reciprocal
mention graphs, home-location propagation by L1 median and hold-out
evaluation — every operator is ``DataFrame(s) + parameters -> DataFrame``.
"""

import sys

from pyspark import cloudpickle

# functions and processors that run in Spark's Python workers travel by value:
# executors need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
