"""The topic run: from labelled comments to ranked topics, actions and export rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from voxframe.operators import signals as sg
from voxframe.operators import topics as tp
from voxframe.session import materialize


def run_topics(
    comments: DataFrame,
    truth: DataFrame | None = None,
    videos: DataFrame | None = None,
    run_id: str = "",
    rules: sg.SignalRules = sg.DEFAULT,
    check: bool = True,
    hold: Callable[[DataFrame], DataFrame] = materialize,
) -> dict[str, DataFrame]:
    """All tables of the topic run.

    Stages read by several later ones are written once to the shared folder (``hold``).
    """
    context = hold(sg.normalize_products(sg.comment_context(comments, truth, videos, run_id), rules))
    units = hold(sg.signal_units(context, rules))
    signals = hold(tp.attach_topics(units, hold=hold))
    topics = hold(tp.build_topics(signals))
    ranked = tp.rank_topics(topics, signals, rules.comparison)
    representatives = hold(tp.select_representatives(topics, signals, comparison=rules.comparison, hold=hold))
    gated = tp.quality_gate(ranked, topics, representatives)
    if check:
        gated = tp.checked(gated, tp.sanity_checks(context, signals, topics))
    gated = hold(gated)
    actions = tp.insight_actions(gated, topics, representatives)
    return {
        "topic_context": context,
        "topic_signals": signals,
        "topics": topics,
        "topic_ranked": gated,
        "topic_representatives": representatives,
        "topic_actions": actions,
        "topic_export_rows": tp.export_rows(gated, topics, actions, context),
    }
