"""Operators for building training corpora; nothing else in the library imports them.

Functions of this package travel to the executors by value, so workers need no
copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
