"""Operators of a training-data pipeline: media archives, WARC, decontamination, licences, mixing,
toxicity, near-duplicates, quality, personal data, URL lists, divergence of sources, token stores and periodic runs."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions with their closures, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
