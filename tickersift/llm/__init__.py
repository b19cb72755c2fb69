"""Operators that prepare corpora and embeddings for training language models.

Functions that run in Python workers travel with the job, so executors need numpy and
pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
