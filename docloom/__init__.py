"""Document analytics on Spark: chunking, retrieval, extraction and review of document collections as DataFrames."""

import sys

from pyspark import cloudpickle

# Python tasks carry this package's functions with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
