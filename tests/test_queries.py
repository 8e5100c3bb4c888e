"""A cross-section of the registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import pytest

from workloads.compare import compare, duck
from tests.conftest import SF

NAMES = (
    "weekly_sentiment_trend weekly_sentiment_window new_issue_keywords video_ranking negative_density spam_like keep_last deep_topk_per_group video_context_salted null_safe_lookup "
    "facet_filter keyword_filter pii_flags mask_pii text_shapes lexicon_sentiment comment_classes truth_table opinion_units strategy_insights similar_comments similar_comments_by_token "
    "keyword_coverage phrases cooccurrence seed_pairs signals thread_flatten video_flatten search_variants run_tables csv_export stream_weekly incremental_upsert stream_new_comments"
).split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    import __spark_entry__ as entry

    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
