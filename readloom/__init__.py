"""readloom: a Spark-native engine for DNA sequencing reads."""

import sys

from pyspark import cloudpickle

# Executors need not have the package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
