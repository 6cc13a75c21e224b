"""A PySpark engine that ranks, verifies and curates groups of agent trajectories."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, which then need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
