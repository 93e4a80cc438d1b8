"""Operators for preparing training text; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors whole, so these need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
