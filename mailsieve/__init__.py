"""Message export, text cleaning and redaction as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Ship this package's functions with each task, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
