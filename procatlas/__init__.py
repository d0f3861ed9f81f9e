"""Analytics over large estates of exported process automations, on Spark.

Every operator takes and returns DataFrames.  ``procatlas.model.Estate`` names
the normalised tables; ``sources`` fills them from XML and JSON exports,
``operators`` analyse them, ``streaming`` keeps them up to date.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
