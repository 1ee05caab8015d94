"""ledgerlens: audit analytics over AP / AR ledgers on Spark.

Every analytic is a function from DataFrames to a DataFrame built from
Spark's own joins, aggregations and windows, so Catalyst plans it and the
cluster runs it.  See README.md for the operator map.
"""

import sys as _sys

__version__ = "0.1.0"

# The few functions that run inside Python workers (mapInPandas /
# applyInPandas) are shipped by value, so executors need not have the
# package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark: ship with --py-files
    pass
