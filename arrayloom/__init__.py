"""Column algebra on Spark DataFrames: ordered vectors, grids, sparse matrices."""

import sys

from pyspark import cloudpickle

# Python kernels travel to the executors inside the job, so that a cluster
# needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
