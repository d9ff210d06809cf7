"""seqspark: Spark-native operators for labelled biological-sequence datasets.

Every operator is a plain ``DataFrame -> DataFrame`` function built on the
PySpark SQL / ML / Structured Streaming APIs.  Randomness is hash based so
that results are reproducible and can be checked against plain SQL.
"""

import sys as _sys

__version__ = "0.1.0"

# Python-side operators (mapInPandas / applyInPandas) reference this package's
# code; pickle it by value so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to an importable package
    pass
