"""Activity segmentation, ordered transcript scans and event logs as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
