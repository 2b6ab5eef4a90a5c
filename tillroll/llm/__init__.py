"""Operators of a training-data pipeline, one module each.

The package is shipped to Python workers by value, so executors need no copy
of the repository on their disks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
