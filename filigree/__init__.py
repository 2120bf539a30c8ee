"""Filigree: a PySpark-native analytics engine for versioned document corpora."""

import sys

from pyspark import cloudpickle

from filigree.session import build_session, load_table, load_tables

__all__ = ["build_session", "load_table", "load_tables"]

# Functions that run on executors travel with their tasks, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
