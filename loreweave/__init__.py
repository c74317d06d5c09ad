"""Loreweave: conversational-memory analytics expressed as Spark DataFrame plans.

Python functions that run on executors are pickled by value, so a cluster needs
nothing installed beside PySpark and the libraries a given operator uses.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
