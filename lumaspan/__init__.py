"""lumaspan: near-duplicate, evidence and job-state analytics declared as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions sent to them are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
