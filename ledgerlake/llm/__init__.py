"""Operators of a training-data pipeline.

Functions that run on executors are sent by value, so that executors need not
have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
