"""Evaluation analytics on Spark: runs, scores, components and catalogues as DataFrames."""

import sys

from pyspark import cloudpickle

ENGINE_VERSION = "0.1.0"

# The few functions that run in Python workers travel with their tasks, so executors need no
# copy of this package installed, nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
