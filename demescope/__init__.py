"""Population-structure analytics over genotype calls, as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: kernels travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
