"""evitrust: evidence harmonization and selective-prediction analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python tasks carry the functions they call, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
