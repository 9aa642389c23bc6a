"""All queries and oracles of the engine's operators."""

from sylvaframe.plans import forests, grid, preparation, reports, stores  # noqa: F401  (they register their queries)
from sylvaframe.plans.queries import ORACLES, QUERIES  # noqa: F401
