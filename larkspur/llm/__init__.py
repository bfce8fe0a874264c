"""Operations for training-data pipelines.

Nothing outside this subpackage imports it.  Python functions that run on
executors are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
