"""creditframe: credit-risk feature, profiling and scoring plans on Spark.

Functions that run inside Python workers (``mapInPandas`` / ``applyInPandas``
bodies) are shipped *by value*, so executors need numpy, pandas and pyarrow
but not this package on their path.  Deployments may still ship the package
with ``--py-files``; both work.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older pickler: fall back to shipping the package
    pass
