"""ledgerlight: procurement-transparency analytics on Spark.

The package is pickled by value into Python workers, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
