"""Operators of a training-data pipeline: scans, filters, deduplication, mixing, packing, sharding."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, whether or not this package is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
