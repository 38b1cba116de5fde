"""textloom: text extraction and corpus analytics as ordinary Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of the package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
