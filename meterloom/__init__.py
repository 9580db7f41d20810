"""Usage metering and training-data preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: executors needn't have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
