"""Text provenance and evidence retrieval on Spark.

Functions that run inside Spark tasks are pickled by value, so that executors
need PySpark and its usual companions but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
