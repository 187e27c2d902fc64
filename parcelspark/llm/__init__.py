"""Training-data operators: ten dealt operators, their registered queries and shared helpers.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
