"""Find and redact secrets and personal data in tables, files and streams of text."""

import sys

from pyspark import cloudpickle

# The few Python workers (document extraction, model hooks) get their functions by
# value, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
