"""Table contracts and the helper that brings any frame into shape."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def _schema(spec: str) -> T.StructType:
    """Flat table contract; needs no session, unlike a DDL string."""
    pairs = [field.strip().split(" ") for field in spec.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


VIDEOS = _schema(
    "run_id string, keyword string, product string, region string, video_id string, title string, "
    "description string, channel_id string, channel_title string, published_at string, duration string, "
    "view_count bigint, like_count bigint, comment_count bigint, tags array<string>, category_id string, "
    "search_rank bigint, matched_keyword string, video_url string"
)
COMMENTS = _schema(
    "run_id string, video_id string, thread_id string, comment_id string, parent_comment_id string, "
    "is_reply boolean, source_type string, live_chat_included boolean, author_display_name string, "
    "author_channel_id string, text_original string, text_display string, like_count bigint, "
    "published_at string, updated_at string, reply_count bigint, total_reply_count bigint, viewer_rating string"
)
ERRORS = _schema("run_id string, video_id string, error string")
COMMENT_TRUTH = _schema(
    "comment_id string, video_id string, text string, text_display string, hygiene_class string, "
    "analysis_included boolean, sentiment_final string, mixed_flag boolean, inquiry_flag boolean, "
    "journey_stage string, judgment_axes array<string>, representative_eligibility boolean"
)
MINING_BASE = _schema(
    "comment_id string, video_id string, text_raw string, text_clean string, created_at timestamp, "
    "product string, brand string, region string"
)
#: Per-comment fields an external labelling step may supply.
ENRICHMENT = _schema(
    "comment_id string, nlp_label string, nlp_confidence double, nlp_sentiment_score double, "
    "nlp_sentiment_reason string, nlp_topics array<string>, nlp_topic_sentiments map<string,string>, "
    "nlp_is_inquiry boolean, nlp_is_rhetorical boolean, nlp_summary string, nlp_keywords array<string>, "
    "nlp_product_mentions array<string>, nlp_language string, nlp_provider string, nlp_model string, "
    "nlp_core_points array<string>, nlp_context_tags array<string>, nlp_similarity_keys array<string>, "
    "nlp_insight_summary string, nlp_confidence_factors array<string>, "
    "nlp_confidence_breakdown map<string,double>, nlp_sentiment_intensity double"
)
_SNIPPET = (
    "struct<textOriginal:string,textDisplay:string,authorDisplayName:string,"
    "authorChannelId:struct<value:string>,likeCount:bigint,publishedAt:string,updatedAt:string,viewerRating:string>"
)
# Page schemas are DDL text: the readers take it as it is.

#: One stored page of comment threads.
THREAD_PAGE = (
    "endpoint string, run_id string, video_id string, collected_at string, page_token string, "
    "payload struct<nextPageToken:string,items:array<struct<id:string,"
    f"snippet:struct<totalReplyCount:bigint,topLevelComment:struct<id:string,snippet:{_SNIPPET}>>,"
    f"replies:struct<comments:array<struct<id:string,snippet:{_SNIPPET}>>>>>>"
)
#: One stored page of replies to a comment.
REPLY_PAGE = (
    "endpoint string, run_id string, video_id string, parent_comment_id string, "
    f"payload struct<items:array<struct<id:string,snippet:{_SNIPPET}>>>"
)
SEARCH_PAGE = (
    "endpoint string, run_id string, page_no bigint, payload struct<items:array<struct<id:struct<videoId:string>>>>"
)
VIDEO_PAGE = (
    "endpoint string, run_id string, payload struct<items:array<struct<id:string,"
    "snippet:struct<title:string,description:string,channelId:string,channelTitle:string,publishedAt:string,"
    "tags:array<string>,categoryId:string>,contentDetails:struct<duration:string>,"
    "statistics:struct<viewCount:string,likeCount:string,commentCount:string>>>>"
)


def require_columns(df: DataFrame, required: Iterable[str], stage: str) -> DataFrame:
    """Raise while the plan is built if a stage lacks input columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"[{stage}] missing required columns: {missing}")
    return df


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Exactly the columns of ``schema``: cast, defaulted where absent or null, in order."""
    defaults = defaults or {}
    out = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def pick(df: DataFrame, names: Sequence[str], default: Column | None = None) -> Column:
    """The first of ``names`` the frame has; null values fall through to the default."""
    for name in names:
        if name in df.columns:
            return F.col(name) if default is None else F.coalesce(F.col(name), default)
    return F.lit(None) if default is None else default


def with_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` the frame does not have, as typed nulls."""
    absent = [f for f in schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in absent]) if absent else df
