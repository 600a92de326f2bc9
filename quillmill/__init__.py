"""quillmill: a Spark-native curation and evaluation library.

Functions that run on executors are sent by value, so the cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
