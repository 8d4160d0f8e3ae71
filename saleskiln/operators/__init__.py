"""DataFrame-to-DataFrame operators."""

from saleskiln.operators.batches import EmptyTableError, latest_batch, newest_batch_time, require_batch
from saleskiln.operators.dedup import duplicate_keys, keep_latest, keep_latest_by_aggregate
from saleskiln.operators.lookup import likely_known, lookup_key, resolved
from saleskiln.operators.parse import explode_lines, parse_or_reject, parse_records, project_fields
from saleskiln.operators.quality import QualityError, drop_null_keys, gate, judge, quality_report
from saleskiln.operators.totals import total_by_member
from saleskiln.operators.upsert import UpsertRule, insert_all, merge_metrics, upsert, upsert_small_batch

__all__ = [
    "EmptyTableError",
    "QualityError",
    "UpsertRule",
    "drop_null_keys",
    "duplicate_keys",
    "explode_lines",
    "gate",
    "insert_all",
    "judge",
    "keep_latest",
    "keep_latest_by_aggregate",
    "latest_batch",
    "likely_known",
    "lookup_key",
    "merge_metrics",
    "newest_batch_time",
    "parse_or_reject",
    "parse_records",
    "project_fields",
    "quality_report",
    "require_batch",
    "resolved",
    "total_by_member",
    "upsert",
    "upsert_small_batch",
]
