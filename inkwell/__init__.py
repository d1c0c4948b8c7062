"""Inkwell: full-text search, text analytics and corpus preparation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
