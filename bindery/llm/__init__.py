"""Operators for preparing training text at scale.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Executors receive these functions with the job itself, so the package need
# not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
