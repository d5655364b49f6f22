"""Training-data operators.  One module per operator; nothing else in the library imports this package.

Worker functions are shipped by value, so executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
