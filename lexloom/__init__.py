"""lexloom: a Spark-first engine for legal-text knowledge graphs."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job, so the package needs no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
