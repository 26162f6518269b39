"""Structured Streaming forms of the event operators.

Stateful functions are shipped to the workers by value: executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
