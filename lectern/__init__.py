"""Document-to-graph analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel whole, so executors need no copy of this
# package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
