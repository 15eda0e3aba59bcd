"""Catalogue extraction from stored web pages as Spark jobs."""

import sys

from pyspark import cloudpickle

# The parser's functions travel to the executors inside the task, so the
# package need not be installed on every worker.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
