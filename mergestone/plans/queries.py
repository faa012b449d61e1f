"""Every query of the integration engine, wired to the driver's tables, beside the SQL that states its result."""

from mergestone.plans import extract_plans, fusion_plans, list_plans, overlay_plans, publish_plans, resolution_plans, scalar_plans, source_plans, stream_plans, version_plans  # noqa: F401
from mergestone.plans.registry import ORACLE, QUERIES  # noqa: F401
