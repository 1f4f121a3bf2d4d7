"""quillstone: a PySpark-native engine for document memory, retrieval and log analytics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
