"""Document retrieval and data-quality operators, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so that executors don't need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
