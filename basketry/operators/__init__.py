"""Reusable distributed operators the query plans are composed from."""

from basketry.operators.bitmaps import dense_ids, distinct_bitmaps, distinct_counts, merged_bitmaps
from basketry.operators.flags import conversion_by, distinct_with_flags, stage_flags
from basketry.operators.ranking import global_rank, ntile_labels, percentiles, rows_at_ranks
from basketry.operators.sequence import nth_event_gap, with_previous
from basketry.operators.shares import share_of_total
from basketry.operators.topn import top_n_joined

__all__ = ["dense_ids", "distinct_bitmaps", "distinct_counts", "merged_bitmaps", "conversion_by", "distinct_with_flags", "stage_flags", "global_rank", "ntile_labels",
           "percentiles", "rows_at_ranks", "nth_event_gap", "with_previous", "share_of_total", "top_n_joined"]
