"""Registered queries: each pairs a Spark job with the SQL that checks it."""

import sys

from pyspark import cloudpickle

# The stand-in clients run in Python workers that may not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
