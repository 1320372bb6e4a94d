"""Tessera: a Spark-first engine for code-graph analytics and training-data pipelines.

Functions take and return DataFrames. Python code that runs on executors is pickled by value, so a
cluster needs the public libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
