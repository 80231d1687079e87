"""Pattern ids and the operators behind them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from kpiloom.operators import (
    discovery,
    entity,
    journey,
    overlap,
    profiles,
    quality,
    segment,
    series,
    threads,
)

PATTERNS: dict[str, Callable[..., DataFrame]] = {
    # general patterns
    "deduplication": entity.latest_per_key,
    "date_spine": series.fill_on_spine,
    "rolling_window": series.rolling,
    "yoy": series.yoy,
    "cohort": journey.cohort,
    "funnel": journey.funnel,
    "waterfall": segment.waterfall,
    "ever_flag": entity.ever_flag,
    "fill_gap": journey.fill_gaps,
    "window_truncation": series.truncation_audit,
    "full_outer": series.actuals_vs_goals,
    "topn": entity.top_n,
    # worked queries
    "entity_summary": journey.entity_summary,
    "comorbidity": segment.comorbidity,
    "monthly_trend": series.monthly_trend,
    "top_cost": entity.top_cost,
    "call_funnel": journey.call_funnel,
    "rolling_range": series.rolling_range,
    "fixed_average": overlap.fixed_average,
    "rolling_new_starts": series.rolling_new_starts,
    "period_growth": series.period_growth,
    "trainee_ratio": segment.trainee_ratio,
    "account_segment": segment.account_segment,
    "bucket_classified": segment.bucket_classified,
    "concordance_market": segment.concordance_market,
    "concordance_provider": segment.concordance_provider,
    "provider_monthly": journey.provider_monthly,
    "provider_cumulative": journey.provider_cumulative,
    "provider_stages": journey.provider_stages,
    "net_new_list": entity.net_new_list,
    "net_new_summary": entity.net_new_summary,
    "fill_episodes": journey.fill_episodes,
    "dosing_schedule": segment.dosing_schedule,
    "dosing_consolidated": segment.dosing_consolidated,
    "route_rules": segment.route_rules,
    "detailed_providers": entity.detailed_providers,
    "age_group_writers": entity.age_group_writers,
    "product_remap": overlap.product_remap,
    "market_flags": overlap.market_flags,
    "overlap_patients": overlap.overlap_patients,
    "recent_products": overlap.recent_products,
    "overlap_recent": overlap.overlap_recent,
    "rank_all": entity.rank_all,
    "fill_gaps_by_day": journey.fill_gaps_by_day,
    "fill_months": series.fill_months,
    "bucket_priority": segment.bucket_priority,
    "account_rollup": segment.account_rollup,
    "route_by_table": segment.route_by_table,
    # checks and search
    "join_fanout": quality.join_fanout,
    "fanout_offenders": quality.fanout_offenders,
    "segment_counts": quality.segment_counts,
    "fanout_check": quality.fanout_check,
    "profile_table": quality.profile_table,
    "grain_check": quality.grain_check,
    "join_cardinality": quality.join_cardinality,
    "grain_discover": discovery.grain_discover,
    "join_keys": discovery.join_keys,
    "heavy_keys": discovery.heavy_keys,
    "profile_sketches": profiles.profile_sketches,
    "merge_profiles": profiles.merge_profiles,
    "profile_report": profiles.profile_report,
    "funnel_ordered": journey.funnel_ordered,
    "provider_cumulative_distinct": journey.provider_cumulative_distinct,
    "freshness": series.freshness,
    "segment_exclusivity": quality.segment_exclusivity,
    "thread_search": threads.thread_search,
}
