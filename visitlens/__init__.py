"""User-behaviour analytics as PySpark DataFrame, SQL and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Functions and classes that run in Python workers travel with their code: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
