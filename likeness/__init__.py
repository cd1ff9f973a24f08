"""likeness: find-by-example analytics over DataFrames of embeddings, tags and files."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the plan, so executors need no copy of it on their path. A module that a task's
# function names travels whole, so such modules hold no UDF objects: once used, those refer to the JVM and can't travel.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
