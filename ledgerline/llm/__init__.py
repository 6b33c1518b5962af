"""Training-data operators. Nothing outside this package imports it.

Functions handed to Spark's Python workers are pickled by value, so workers
need numpy, pandas and the tokenizer libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
