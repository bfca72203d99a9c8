"""Corpus, vocabulary and telemetry operators for language-model training data on Spark.

Every operator takes DataFrames and parameters and returns a DataFrame.
"""

import sys

from pyspark import cloudpickle

# Python functions travel to the tasks by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
