"""All registered queries, gathered by inventory section."""

from wirelens.plans.registry import ORACLES, QUERIES  # noqa: F401
from wirelens.plans import checks_scalars  # noqa: F401
from wirelens.plans import checks_similar  # noqa: F401
from wirelens.plans import checks_items  # noqa: F401
from wirelens.plans import checks_joins  # noqa: F401
from wirelens.plans import checks_reports  # noqa: F401
