"""Spark-first analytics for labelled text corpora: cleaning, duplicates, leakage, sampling, features, metrics."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the workers by value: they need no copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
