"""arrears: a Spark-native engine for text that admits its own debts, the graph between such texts and the commits that settle them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so a cluster needs no --py-files for them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
