"""End-to-end plans and the registered queries."""

from veilscan.plans.scan import (  # noqa: F401
    direct_item_scan,
    direct_object_scan,
    discovery_workflow,
    full_scan,
    masked_copy,
    run_scan,
    ScanConfig,
)
