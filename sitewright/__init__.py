"""A PySpark-native engine that turns tables of fetched web pages into curated, machine-readable site indexes."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
