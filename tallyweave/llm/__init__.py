"""Training-data operators. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with each task.
cloudpickle.register_pickle_by_value(sys.modules["tallyweave"])
