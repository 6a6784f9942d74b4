"""Detections to landings, dose, yield and curated datasets as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
