"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the task, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
