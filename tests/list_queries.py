"""Names of the queries registered by one module: python -m tests.list_queries model_queries"""

import importlib
import sys

from flowprism.plans.registry import QUERIES

for module in sys.argv[1:]:
    before = set(QUERIES)
    importlib.import_module(f"flowprism.plans.{module}")
    print(" ".join(n for n, f in QUERIES.items() if f.__module__ == f"flowprism.plans.{module}"))
