"""The corpus pipeline under the name that the driver looks for; its stages are in ``wirelens.llm.stages``."""

from wirelens.llm.stages import ORACLE_SQL, STAGES, run  # noqa: F401
