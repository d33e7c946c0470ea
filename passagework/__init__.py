"""Document retrieval on Spark: ingest, chunk, embed, search, cite and prompt, set-at-a-time."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their tasks, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
