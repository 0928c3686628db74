"""veilscan: sensitive-data discovery, classification and masking on Spark.

Layers:
  rules       fixed rule data (patterns, vocabularies, masking defaults)
  functions   rules compiled to built-in Column expressions
  operators   DataFrame -> DataFrame detection, tagging, masking, reports
  sources     catalog, object listing, samples, sinks
  plans       end-to-end scans composed from operators
  streaming   the stateless detectors and masks on readStream

The main entry points are importable from the package root; they load on
first use.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    "content_findings": "veilscan.operators.findings",
    "column_name_findings": "veilscan.operators.findings",
    "merge_entity_scores": "veilscan.operators.findings",
    "scan_items_json": "veilscan.operators.findings",
    "scan_objects": "veilscan.operators.findings",
    "column_content_profile": "veilscan.operators.findings",
    "mask_table": "veilscan.operators.masking",
    "mask": "veilscan.functions.mask",
    "masking_rule": "veilscan.functions.mask",
    "content_types": "veilscan.functions.detect",
    "name_types": "veilscan.functions.detect",
    "data_classification": "veilscan.functions.classify",
    "access_level": "veilscan.functions.classify",
    "full_scan": "veilscan.plans.scan",
    "run_scan": "veilscan.plans.scan",
    "ScanConfig": "veilscan.plans.scan",
    "discovery_workflow": "veilscan.plans.scan",
    "local_session": "veilscan.session",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    module = _EXPORTS.get(name)
    if module is None:
        raise AttributeError(f"module 'veilscan' has no attribute {name!r}")
    return getattr(importlib.import_module(module), name)
