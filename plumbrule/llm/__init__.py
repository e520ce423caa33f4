"""Operators for training-data pipelines. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code: those need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
