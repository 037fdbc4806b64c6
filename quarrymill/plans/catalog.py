"""All queries over the driver tables, with their SQL."""

from quarrymill.plans import forecasts, layers, reference, selection  # noqa: F401  (they register their queries)
from quarrymill.plans.purchases import ORACLE_SQL, QUERIES  # noqa: F401
