"""Attestary: dossier extraction, provenance and form filling as Spark tables.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing is
collected to the driver and every table is keyed by ``job_id``, so one plan serves one dossier
or a hundred million of them.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: the small helpers inside its UDFs travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
