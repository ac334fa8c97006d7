"""Transaction monitoring as Spark jobs: ingest, score, alert, report, usage control.

Every operator is a function from DataFrames to a DataFrame. What reaches the driver is counts and
other single rows, never rows of a table; the clock, thresholds and limits are arguments.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with the job: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])
