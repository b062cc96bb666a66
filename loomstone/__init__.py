"""Loomstone: content-addressed block analytics on Spark DataFrames.

Functions that run on executors are pickled by value, so executors need no
copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
