"""Score maps, document indexes and click-log replay as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value: workers need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
