"""DataFrame operators: detection, tagging, masking, reports."""

from veilscan.operators.findings import (  # noqa: F401
    analyze_table,
    column_name_findings,
    content_findings,
    content_findings_long,
    head_byte_findings,
    head_char_findings,
    merge_entity_scores,
    scan_items_json,
    scan_objects,
    scan_string_attributes,
    with_classification,
)
from veilscan.operators.masking import column_types_by_name, mask_preview, mask_table  # noqa: F401
from veilscan.operators.reports import (  # noqa: F401
    classification_summary,
    kpis,
    pii_type_counts,
    run_counts,
    scan_totals,
    split_findings,
    tag_keys_used,
    type_summary,
    unified_findings,
    workflow_summary,
)
from veilscan.operators.tags import (  # noqa: F401
    apply_tags,
    classify_sources,
    column_tags,
    ensure_tag_definitions,
    register_resources,
    source_tags,
    table_classification,
    tag_definitions,
)
