"""From stored pages to flat videos and comments, quota use, and search-term variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import collapse_space
from voxframe.operators.relational import attach, top_per_group, unnest
from voxframe.schemas import COMMENTS, VIDEOS, conform

# Cost of one call per endpoint.
QUOTA_COSTS = {"search.list": 100, "videos.list": 1, "commentThreads.list": 1, "comments.list": 1}
DEFAULT_PRODUCT = "가전제품"
MARKET_LANGUAGES = {
    "KR": ("ko",), "US": ("en",), "CA": ("en", "fr"), "GB": ("en",), "FR": ("fr",), "IT": ("it",), "DE": ("de",), "SA": ("ar",), "EG": ("ar",),
    "IN": ("hi", "en"), "ID": ("id",), "RU": ("ru",), "VN": ("vi",), "TW": ("zh-TW",), "TH": ("th",), "AU": ("en",), "BR": ("pt",), "CO": ("es",),
    "MX": ("es",), "PE": ("es",),
}


def _comment(snippet: str, comment_id: Column, parent: Column, is_reply: bool, reply_count: Column, total: Column) -> list[Column]:
    s = lambda name: F.col(f"{snippet}.{name}")
    original = F.coalesce(F.nullif(s("textOriginal"), F.lit("")), F.nullif(s("textDisplay"), F.lit("")), F.lit(""))
    return [
        F.col("run_id"), F.col("video_id"), F.col("thread_id"), comment_id.alias("comment_id"), parent.alias("parent_comment_id"), F.lit(is_reply).alias("is_reply"),
        F.lit("YT_COMMENT").alias("source_type"), F.lit(False).alias("live_chat_included"), s("authorDisplayName").alias("author_display_name"),
        s("authorChannelId.value").alias("author_channel_id"), original.alias("text_original"),
        F.coalesce(F.nullif(s("textDisplay"), F.lit("")), original).alias("text_display"), F.coalesce(s("likeCount"), F.lit(0)).alias("like_count"),
        s("publishedAt").alias("published_at"), s("updatedAt").alias("updated_at"), reply_count.alias("reply_count"), total.alias("total_reply_count"),
        s("viewerRating").alias("viewer_rating"),
    ]


def flatten_threads(pages: DataFrame, include_replies: bool = True) -> DataFrame:
    """One row per top comment and per reply embedded in a thread page."""
    c = F.col
    items = unnest(pages, c("payload.items"), "item", "run_id", "video_id").select(
        "run_id", "video_id", "item", F.coalesce(c("item.id"), c("item.snippet.topLevelComment.id")).alias("thread_id"),
        c("item.snippet.topLevelComment.id").alias("top_id"), F.coalesce(c("item.snippet.totalReplyCount"), F.lit(0)).alias("total"),
    )
    none = F.lit(None).cast("string")
    top = items.select(*_comment("item.snippet.topLevelComment.snippet", c("top_id"), none, False, c("total"), c("total")))
    if not include_replies:
        return conform(top, COMMENTS)
    open_threads = items.where((c("total") > 0) & c("top_id").isNotNull())
    replies = unnest(open_threads, c("item.replies.comments"), "reply", "run_id", "video_id", "thread_id", "top_id", "total")
    embedded = replies.select(*_comment("reply.snippet", c("reply.id"), c("top_id"), True, F.lit(0), c("total")))
    return conform(top.unionByName(embedded), COMMENTS)


def complete_replies(comments: DataFrame, reply_pages: DataFrame) -> DataFrame:
    """Add replies from reply pages; a reply that came with its thread stays as it was."""
    c = F.col
    threads = comments.where(~c("is_reply")).select("video_id", c("comment_id").alias("top_id"), "thread_id", c("total_reply_count").alias("total"))
    rows = unnest(reply_pages, c("payload.items"), "reply", "run_id", "video_id", c("parent_comment_id").alias("top_id"))
    known = rows.join(threads, ["video_id", "top_id"])
    fetched = known.select(*_comment("reply.snippet", c("reply.id"), c("top_id"), True, F.lit(0), c("total")))
    both = comments.withColumn("__source", F.lit(0)).unionByName(conform(fetched, COMMENTS).withColumn("__source", F.lit(1)))
    return top_per_group(both, ["video_id", "comment_id"], [c("__source"), c("published_at")], 1).drop("__source")


#: Search pages that are summed together.
PAGES_PER_BAND = 1000


def flatten_videos(search_pages: DataFrame, video_pages: DataFrame, keyword: str, region: str, product: str | None = None) -> DataFrame:
    """Video details with their search rank (page order), counts as numbers and a link."""
    c = F.col
    hits = unnest(search_pages, c("payload.items"), "item", "run_id", "page_no", position="pos").where(c("item.id.videoId").isNotNull())
    # The first position of a video; ranks count over the pages in order.
    sizes = search_pages.select("run_id", "page_no", F.size(F.filter("payload.items", lambda i: i["id"]["videoId"].isNotNull())).alias("n"))
    # Pages of a run are summed by bands of page numbers first, so that no task sorts all pages of a run.
    sizes = sizes.withColumn("band", F.floor(c("page_no") / PAGES_PER_BAND))
    bands = sizes.groupBy("run_id", "band").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("run_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("run_id", "band").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = bands.select("run_id", "band", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    offsets = sizes.join(starts, ["run_id", "band"]).select("run_id", "page_no", (c("start") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("offset"))
    ranked = hits.join(offsets, ["run_id", "page_no"]).groupBy("run_id", c("item.id.videoId").alias("video_id")).agg(F.min(c("offset") + c("pos") + 1).alias("search_rank"))
    v = unnest(video_pages, c("payload.items"), "v", "run_id")
    number = lambda name: c(f"v.statistics.{name}").try_cast("bigint")
    flat = v.select(
        "run_id", F.lit(keyword).alias("keyword"), F.lit(product or DEFAULT_PRODUCT).alias("product"), F.lit(region).alias("region"), c("v.id").alias("video_id"),
        c("v.snippet.title").alias("title"), c("v.snippet.description").alias("description"), c("v.snippet.channelId").alias("channel_id"),
        c("v.snippet.channelTitle").alias("channel_title"), c("v.snippet.publishedAt").alias("published_at"), c("v.contentDetails.duration").alias("duration"),
        number("viewCount").alias("view_count"), number("likeCount").alias("like_count"), number("commentCount").alias("comment_count"),
        F.coalesce(c("v.snippet.tags"), F.array().cast("array<string>")).alias("tags"), c("v.snippet.categoryId").alias("category_id"),
        F.lit(keyword).alias("matched_keyword"), F.concat(F.lit("https://www.youtube.com/watch?v="), c("v.id")).alias("video_url"),
    )
    return conform(flat.join(ranked, ["run_id", "video_id"], "left"), VIDEOS)


def merge_keyword_results(results: DataFrame, limit: int, keyword_order: str = "keyword_order") -> DataFrame:
    """Videos of several searches: the first search that found one wins, then rank and comments order them."""
    c = F.col
    once = top_per_group(results, ["video_id"], [c(keyword_order), c("search_rank")], 1)
    order = [F.coalesce("search_rank", F.lit(999999)), F.coalesce("comment_count", F.lit(0)).desc(), c("video_id")]
    return once.orderBy(*order).limit(limit)


def not_collected(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """Videos without any collected comment yet."""
    return attach(videos, comments.select("video_id").distinct(), ["video_id"], "left_anti", derived=True)


def quota_usage(calls: DataFrame, costs: Mapping[str, int] = QUOTA_COSTS, daily_limit: int | None = None) -> DataFrame:
    """Calls and cost units per endpoint, and whether the total exceeds the daily limit."""
    price = F.create_map(*[F.lit(x) for pair in costs.items() for x in pair])
    out = calls.groupBy("endpoint").agg(F.count("*").alias("calls"))
    out = out.withColumn("units", F.col("calls") * F.coalesce(F.element_at(price, F.col("endpoint")), F.lit(0)))
    if daily_limit is None:
        return out
    return out.withColumn("over_limit", out.agg(F.sum("units")).scalar() > daily_limit)


def estimate_quota(plans: DataFrame, page_size: int = 50, costs: Mapping[str, int] = QUOTA_COSTS) -> DataFrame:
    """Planned calls and units from ``max_videos``, ``comments_per_video`` and ``include_replies``."""
    c = F.col
    pages = F.ceil(c("max_videos") / page_size)
    wanted = F.when(c("comments_per_video") > 0, c("comments_per_video")).otherwise(page_size * 20)
    threads = c("max_videos") * F.ceil(wanted / page_size)
    out = plans.withColumns({"search_calls": pages, "video_calls": pages, "thread_calls": threads})
    out = out.withColumn("reply_calls", F.when(c("include_replies"), F.ceil(c("thread_calls") * F.lit(0.3))).otherwise(0))
    units = (
        c("search_calls") * costs["search.list"] + c("video_calls") * costs["videos.list"]
        + c("thread_calls") * costs["commentThreads.list"] + c("reply_calls") * costs["comments.list"]
    )
    return out.withColumn("total_units", units)


def search_variants(seeds: DataFrame, translations: DataFrame, language: str | None = None, limit: int = 5,
                    markets: Mapping[str, Sequence[str]] = MARKET_LANGUAGES) -> DataFrame:
    """The seed and its translations in the languages of its market, distinct without regard to case.

    ``seeds`` has keyword and region; ``translations`` has keyword, language and term.
    """
    c = F.col
    if language and language.lower() not in {"all", "any", "other", "*"}:
        languages = F.array(F.lit(language))
    else:
        table = F.create_map(*[x for k, v in markets.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
        own = F.coalesce(F.element_at(table, F.upper("region")), F.array().cast("array<string>"))
        languages = F.array_distinct(F.concat(own, F.array(F.lit("ko"), F.lit("en"))))
    base = seeds.select(collapse_space(c("keyword")).alias("keyword"), "region").where(c("keyword") != "")
    asked = unnest(base.withColumn("__langs", languages), c("__langs"), "language", "keyword", "region", position="__pos")
    found = attach(asked, translations.select("keyword", "language", collapse_space(c("term")).alias("term")), ["keyword", "language"], "inner")
    rows = base.select("keyword", "region", c("keyword").alias("term"), F.lit(-1).alias("__pos")).unionByName(
        found.where(c("term") != "").select("keyword", "region", "term", "__pos")
    )
    once = top_per_group(rows.withColumn("__fold", F.lower("term")), ["keyword", "region", "__fold"], [c("__pos")], 1)
    return top_per_group(once, ["keyword", "region"], [c("__pos")], limit, "variant").select("keyword", "region", "variant", "term")
