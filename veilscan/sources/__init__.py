"""Sources and sinks: catalog, objects, samples, reports."""

from veilscan.sources.catalog import (  # noqa: F401
    catalog_columns,
    catalog_columns_from_frames,
    catalog_partitions,
    catalog_tables,
    discover_sources,
    file_database_name,
    register_sources,
)
from veilscan.sources.footers import column_statistics  # noqa: F401
from veilscan.sources.objects import (  # noqa: F401
    all_objects,
    object_findings,
    object_inventory,
    object_texts,
    source_summary,
    table_stats,
    tables_stats,
)
from veilscan.sources.samples import sample_rows  # noqa: F401
from veilscan.sources.sinks import write_findings, write_report  # noqa: F401
from veilscan.sources.windows import object_windows  # noqa: F401
