"""tessera: sequence preparation and model-output evaluation on Spark.

Every public function takes and returns ``DataFrame`` objects; nothing is
collected to the driver except bounded metadata (partition counts, the
per-round merge list of the BPE trainer, a scalar class count).
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside tasks travel with the task itself, so that
# executors need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
