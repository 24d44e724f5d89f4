"""Automated table analysis on Spark: profiling, cleaning, clustering, classification, question answering."""

import sys

from pyspark import cloudpickle

from tabulon.session import build_session

# Functions that run inside tasks travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
