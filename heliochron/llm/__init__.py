"""Operators that prepare training text for language models.

Everything here runs as Spark jobs over a table of documents.  The functions that run inside tasks
are pickled by value, so executors need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
