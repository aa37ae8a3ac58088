"""Operators that prepare text corpora for training: mixing, filtering, matching, counting and sharding.

What runs in tasks is sent by value, so executors need no copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
