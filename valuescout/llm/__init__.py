"""Operators for preparing training data, and the queries that apply them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with their code, so that executors need
# Spark and the listed libraries only, no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
