"""Operators for training-data pipelines; nothing outside this folder imports them.

Functions that run in tasks travel by value, so that executors need no copy of this folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
