"""Content-graph analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the helper functions inside the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
