"""Search and analytics over fingerprinted graph records, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
