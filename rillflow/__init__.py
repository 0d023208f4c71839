"""rillflow: terrain, river-network and corpus analytics written as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
