"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this folder imports it.  The registered
queries live in :mod:`ruleframe.llm.queries`.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value: a cluster needs
# no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
