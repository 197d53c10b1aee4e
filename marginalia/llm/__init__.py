"""Operators for preparing training text: each is a function from DataFrames to a DataFrame.

The modules are shipped to executors by value, so a job needs no installed
copy of this package on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
