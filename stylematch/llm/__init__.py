"""Operators for training-data pipelines: cleaning, search, deduplication, formatting and mixing of corpora."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Workers get the functions of this package with the job, so they need no copy of the repository.
register_pickle_by_value(sys.modules[__name__])
