"""Operators of a training-data pipeline over tables of documents and vectors."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the task: these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
