"""Column-expression layer: every rule as a built-in Spark expression."""

from veilscan.functions.classify import (  # noqa: F401
    access_level,
    data_classification,
    pii_classification,
    primary_type,
    source_governance,
    source_risk,
    types_string,
)
from veilscan.functions.detect import (  # noqa: F401
    confidence_map,
    content_hit,
    content_hits,
    content_types,
    java_regex,
    name_types,
    one_row_if_any,
    source_types,
)
from veilscan.functions.mask import (  # noqa: F401
    MaskingRule,
    default_rules,
    mask,
    mask_by_type,
    masking_rule,
    merged_rules,
    strategies,
)
from veilscan.functions.text import head_bytes, head_chars, suffix_filter  # noqa: F401
