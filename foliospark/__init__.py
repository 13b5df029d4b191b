"""foliospark: document analytics on the PySpark DataFrame, SQL and Structured Streaming APIs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
