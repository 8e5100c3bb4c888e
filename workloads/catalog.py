"""Imports every workload module so that its queries are registered."""

from workloads import audit_tables, card_tables, counts, label_tables, mining_tables, opinion_tables, source_tables, strategy_tables, text_tables, topic_tables, trend_tables, view_tables  # noqa: F401
