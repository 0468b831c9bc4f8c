"""Diachronic lexicon analytics on Spark DataFrames.

``functions``  Column expressions (text, wikitext, phonetics, vectors, replies)
``operators``  DataFrame -> DataFrame building blocks
``plans``      composed jobs (consolidation, Latin merge/clean, prediction, harvest)
``sources``    readers and sinks
``streaming``  restartable, incremental runs
``registry``   the queries bound to the driver's tables, with their SQL checks
"""

import sys

from pyspark import cloudpickle

# Functions travel to executors inside their tasks; no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
