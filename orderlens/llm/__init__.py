"""Operators for preparing training text: scoring, near duplicates, filters, mixing and packing.

Nothing else in the library imports this subpackage; `queries.py` holds its registered queries.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their code: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
