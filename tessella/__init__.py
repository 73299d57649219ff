"""Audience analytics on Spark: ingest, profiles, vector search, audiences and streams."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
