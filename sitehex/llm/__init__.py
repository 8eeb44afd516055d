"""Operators of a training-data pipeline, one module each. Nothing else in the library imports them.

Tasks carry the code of this package with them, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
