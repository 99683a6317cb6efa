"""hybridlake: hybrid retrieval and data processing over code and documents, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so executors needn't have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
