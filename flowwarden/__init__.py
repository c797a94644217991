"""Network-flow detection, response and evaluation as PySpark jobs."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code along, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
