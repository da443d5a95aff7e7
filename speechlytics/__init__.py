"""Speech-transcript analytics on PySpark: lazy ``Column -> Column`` and ``DataFrame -> DataFrame`` operators."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so that it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
