"""Column helpers: missing-value semantics, text, time and fixed lookup values."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with their code, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
