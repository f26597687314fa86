"""Timed-text and scene-timeline analytics on Spark.

Functions of this package that run on executors travel with each job, so a
cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
