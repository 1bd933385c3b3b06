"""Directory consolidation and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
