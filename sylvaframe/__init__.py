"""sylvaframe: label, grid and evaluation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Workers needn't have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
