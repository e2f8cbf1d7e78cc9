"""Every query of the library by name, over the driver's tables."""

from . import features, intervals, rules, tables, views  # noqa: F401  (they register their queries)
from .catalog import ORACLES, QUERIES  # noqa: F401
