"""sievemark: find personal data in text and grade PII guard models, on Spark.

Column builders live in ``functions``, DataFrame operators in ``operators``,
readers and writers in ``sources``, Structured Streaming jobs in ``streaming``
and whole workflows plus the registered queries in ``plans``.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
