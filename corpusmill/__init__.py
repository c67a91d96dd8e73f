"""corpusmill: a PySpark-native engine for preparing and auditing labelled text corpora.

Functions that run in Python workers are pickled by value, so executors need
the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
