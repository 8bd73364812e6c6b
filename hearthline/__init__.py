"""Property-listing analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value: executors need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
