"""millrace: corpus analytics and retrieval queries as DataFrame plans.

Subpackages: ``functions`` (Column -> Column), ``operators`` (DataFrame ->
DataFrame), ``sources`` (readers and writers), ``streaming`` (Structured
Streaming) and ``plans`` (the named queries over the test tables and their SQL).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions sent to executors carry their code, so executors need no copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
