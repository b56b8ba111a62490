"""rectifold: profile, detect, repair and score data-quality defects of tables, as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that Spark sends to its workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
