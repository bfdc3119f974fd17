"""Transcript retrieval, statistics and a knowledge ledger on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
