"""Training-data operators."""

from pyspark import cloudpickle

from voxframe import session

# Travels with the modules that use it: executors need not have this package.
cloudpickle.register_pickle_by_value(session)
