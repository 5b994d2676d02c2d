"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Worker functions defined here are
pickled by value, so executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
