"""Concept mapping between vocabularies as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers by value, so the package need not be
# installed or importable there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
