"""All registered queries and their SQL."""

import importlib
import pkgutil

from tidemark import plans
from tidemark.plans.base import ORACLE_SQL, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_q")):
    importlib.import_module(f"tidemark.plans.{_m}")

__all__ = ["ORACLE_SQL", "QUERIES"]
