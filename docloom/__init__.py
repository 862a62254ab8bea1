"""docloom: a Spark document index and bulk hybrid search."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the tasks; executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
