"""Training-data pipeline operators.

Functions and classes of this subpackage travel to executors by value, and what it
broadcasts is plain data, so that executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
