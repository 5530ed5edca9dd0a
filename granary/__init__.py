"""A PySpark engine for box relations, event streams and text corpora."""

import sys

from pyspark import cloudpickle

# Tasks get the code with the closure, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
