"""Identity-aware evaluation of predictions on large trial tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

# the few functions that run in Arrow batches travel with the job, so executors
# need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
