"""Operators for preparing training text at scale.

Every module holds one operator with its own general interface; `queries`
registers a thin query over the driver tables for each of them. Nothing
outside this package (and `corpus_pipeline.py`) imports it.

Common rules, true for every operator here unless its docstring says more:

* a null text is an empty text; an empty table gives an empty result;
* only the columns named in the signature are read, extra columns never clash;
* rows that repeat a document id are kept as rows of their own; where an order
  of documents matters, rows with one id are ordered by a hash of their text;
* rows without a document id come first in any order of documents.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
