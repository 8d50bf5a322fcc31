"""Operators for preparing training text. Nothing outside this subpackage imports it.

Task code is pickled by value, so executors need neither this package nor a shared folder
to run it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
