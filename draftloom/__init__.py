"""draftloom: a PySpark-native analytics engine for draft-style decision problems."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to Python workers travel by value: workers need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
