"""Usage analytics for LLM call telemetry, written as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions and classes with their closures, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
