"""Point-location and gazetteer analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
