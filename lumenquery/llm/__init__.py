"""Operators for large training-data pipelines.

Functions of this package run inside Spark's Python workers.  They travel by
value, so that executors need no installed copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
