"""The registered queries: each operator over tables derived from the given parquet files."""

from stylematch.workload import cards, evaluation, files, functions, grouped, models, rows, scoring, streams  # noqa: F401
from stylematch.workload.registry import COVERS, QUERIES, oracles  # noqa: F401
