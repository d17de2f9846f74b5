"""Infrastructure-telemetry analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run in tasks travel with the job, so that executors need
# no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
