"""Review analytics for engineering documents, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Small helpers travel with the task that uses them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
