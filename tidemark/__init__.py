"""tidemark: a Spark-first engine for multi-source retrieval and text-corpus analytics.

Functions take and return DataFrames; nothing here holds data or changes the
session's settings. Python code that runs on executors is pickled by value, so
workers need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
