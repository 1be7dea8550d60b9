"""Order-by-order market data on Spark. Functions of this package travel with the plan, so executors need no copy of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
