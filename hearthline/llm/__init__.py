"""Operators of a training-data pipeline. Their Python helpers travel to the executors by value."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
