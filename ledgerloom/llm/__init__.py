"""Operators of a training-data pipeline (packing, WARC, quality, dedup, ...).

Nothing else in the library imports this package. ``queries.py`` holds the
registered ``opN_<name>`` queries, ``oracles.py`` their SQL. Functions that
run in tasks travel by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
