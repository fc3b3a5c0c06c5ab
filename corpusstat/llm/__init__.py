"""Operators that prepare training text for language models.

Each module holds one operator with its own general interface; `queries` holds
the thin registered queries. Nothing outside this subpackage imports it.

The functions that run in Spark's Python workers are pickled with their code,
so executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
