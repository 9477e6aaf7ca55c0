"""Operators for training-data pipelines; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Ship the functions that run in Python workers inside the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
