"""Spark-native curation, scoring and monitoring operators for language-model data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python code of this package travels with the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
