"""wordloom: text analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside Python workers (pandas UDFs) are
# shipped by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
