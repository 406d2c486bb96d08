"""maskframe: sensitive-data detection, reversible masking and corpus tooling on Spark.

Subpackages: ``functions`` (checksums and column expressions), ``operators`` (detection,
masking, policy, audit, evaluation, corpus), ``sources`` (readers and writers), ``plans``
(the query catalogue), ``streaming`` (stateful jobs).
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
