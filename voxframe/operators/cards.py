"""What a representative card needs: clauses, keywords, problem signal, action domain, evidence and strength."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.markers import best_label, contains_any, hit_count, may_hold
from voxframe.functions.scores import clamp
from voxframe.functions.text import bound, collapse_space, looks_garbled, preview, safe_text, written_phrase
from voxframe.operators.relational import top_per_group
from voxframe.rules import display, messages
from voxframe.schemas import pick

# Words that decide which clause, signal and action domain a comment gets.
CLAUSE_NOISE = ("쿠팡 파트너스", "일정 수수료", "본 링크", "보러가기", "더보기 클릭", "구매링크", "sponsored", "affiliate")
ISSUE_WORDS = (
    "고장", "불량", "소음", "진동", "세척", "건조", "세탁", "냉각", "누수", "환불", "수리", "서비스", "가격", "비용", "비싸", "권유", "해지", "위약금",
    "불편", "무겁", "허리", "추천", "만족", "최고", "좋",
)
QUESTION_WORDS = ("왜", "어떻게", "언제", "몇", "얼마", "가능", "되나요", "인가요", "?")
SIGNALS = (
    ("consumable_burden", ("필터", "소모품", "교체")),
    ("manual_intervention", ("손으로", "직접", "붙어", "떼어", "scrub", "manual")),
    ("reliability_failure", ("고장", "불량", "멈춤", "누수", "파손", "fail", "broken")),
    ("service_response_gap", ("a/s", "as", "수리", "기사", "센터", "지연", "출장")),
    ("installation_delivery_gap", ("배송", "설치", "방문", "일정", "공간")),
    ("pricing_contract_gap", ("가격", "비용", "할부", "약정", "해지", "위약금", "구독", "price", "cost", "money", "expensive")),
    ("onboarding_guide_gap", ("안내", "설명", "매뉴얼", "설정", "사용법", "초기", "세팅")),
    ("message_expectation_gap", ("광고", "과장", "홍보", "영상처럼", "기대와", "다름")),
    ("advocacy_signal", ("추천", "재구매", "지인", "소개", "만족", "좋")),
)
ADVOCACY_WORDS = (
    "추천", "재구매", "지인", "소개", "recommend", "buy again", "세척", "소독", "깨끗", "위생", "편리", "만족", "좋", "clean", "sanitize",
)
MANUAL_WORDS = ("손으로", "직접", "수동", "귀찮", "번거", "청소", "설거지", "붙어", "떼어", "manual", "scrub")
ODOR_WORDS = ("냄새", "악취", "odor", "smell")
ODOR_CLEAR = ("냄새없", "냄새 없음", "냄새는 없", "악취 없음", "no smell", "without smell", "odor free")
ODOR_NEGATIVE = ("냄새 나", "악취", "불편", "민원", "문제", "지독", "거슬", "힘들")
DOMAINS = ("product", "operations / service", "business / policy", "UX / guide", "marketing / message")
STAGE_DOMAINS = {
    "인지": (("marketing / message", 2),), "탐색": (("marketing / message", 2), ("business / policy", 1)),
    "구매": (("business / policy", 2), ("marketing / message", 1)), "결정": (("business / policy", 2), ("marketing / message", 1)),
    "배송": (("operations / service", 3),), "사용준비": (("UX / guide", 3), ("operations / service", 1)), "사용": (("product", 2), ("UX / guide", 1)),
    "관리": (("operations / service", 2), ("product", 1)), "교체": (("business / policy", 2), ("product", 1)),
}
SIGNAL_DOMAINS = {
    "odor_leakage": ("product", 3), "consumable_burden": ("UX / guide", 2), "manual_intervention": ("product", 2), "reliability_failure": ("product", 3),
    "service_response_gap": ("operations / service", 3), "installation_delivery_gap": ("operations / service", 3), "pricing_contract_gap": ("business / policy", 3),
    "onboarding_guide_gap": ("UX / guide", 3), "message_expectation_gap": ("marketing / message", 3), "advocacy_signal": ("marketing / message", 2),
}
SEVERE_WORDS = ("고장", "수리", "환불", "불량", "최악", "소음", "진동", "누수", "문제")
CLAIM_NEGATIVE = ("비추", "불만", "문제", "고장", "안됨", "최악", "불편", "비싸", "돈낭비", "냄새", "not work", "doesn't", "broken", "worst", "bad", "refund")
CLAIM_POSITIVE = (
    "만족", "추천", "좋아요", "좋다", "잘됨", "괜찮", "문제없", "불만없", "최고", "works", "great", "excellent", "love", "recommend", "satisfied",
)


# Words of flags, conflicts and aspects.
INQUIRY_WORDS = (
    "어떻게", "어디", "왜", "무엇", "뭔가요", "가능한가", "가능할까요", "인가요", "될까요", "문의", "질문", "how", "where", "why", "what", "can i", "does it", "is it",
)
AMOUNT_UNITS = ("년", "개월", "주", "일", "시간", "분", "초", "번", "회", "만원", "원", "%", "kg", "l", "리터", "도", "w", "kwh")
AMOUNT_WORDS = ("몇", "얼마", "몇번", "몇 회", "how many", "how much", "비용", "가격", "용량", "전기세")
REASON_NEGATIVE = ("불만", "문제", "고장", "불편", "환불", "불량", "리스크", "개선 필요", "저하")
REASON_POSITIVE = ("만족", "추천", "강점", "우수", "좋", "최고", "전환", "기여")
TAG_ASPECTS = {
    "구독/계약": "Cost", "A/S·수리": "A/S & Support", "배송·설치": "Delivery/Install", "가격·비용": "Cost", "성능·품질": "Performance", "사용성·편의": "Convenience/Usability",
    "비교 맥락": "Product Experience", "구매 전환": "Cost", "추천 의도": "Product Experience", "문의/해결요청": "A/S & Support",
}
TEXT_ASPECTS = (
    (("as", "수리", "서비스", "출장", "보증", "연락"), "A/S & Support"), (("소음", "진동", "탈수", "세척", "성능", "냉각", "건조"), "Performance"),
    (("불편", "편함", "무겁", "허리", "꺼내", "조작", "사용"), "Convenience/Usability"), (("가격", "비싸", "비용", "전기세"), "Cost"), (("배송", "설치", "기사"), "Delivery/Install"),
    (("고장", "내구", "수명", "망가"), "Durability"),
)

# Words that choose the clause of a card and the subjects a reason names.
PRAISE_WORDS = ("좋", "만족", "편리", "잘", "유용", "추천", "재구매", "깨끗", "소독", "세척", "냄새없", "문제없", "최고")
COMPLAINT_WORDS = ("불편", "어렵", "힘들", "문제", "고장", "불량", "냄새 나", "악취", "지연", "답답", "안됨", "안 돼", "못", "누수")
NO_COMPLAINT = ("불편함은 없", "문제는 없")
SMART_WORDS = ("smart", "ai", "digital button", "digital control", "스마트", "ai 기능", "디지털 버튼")
SUBJECTS = (
    (("스마트", "smart", "ai", "digital"), "쓸데없는 기능"), (("소음", "noise"), "소음"), (("고장", "repair", "replace", "수리"), "고장·수리"),
    (("성능", "wash", "clean", "세탁"), "세탁 성능"), (("비싸", "price", "deal"), "가격 부담"), (("delivery", "shipping", "배송"), "배송"),
    (("customer support", "service", "as", "고객지원", "서비스"), "고객지원"),
)


def split_clauses(text: Column) -> Column:
    """Clauses of a comment without links, fragments and advertising; the whole text if none is left."""
    def worded(p: Column) -> Column:
        return (F.length(p) >= 4) & p.rlike("[A-Za-z0-9가-힣]{2,}") & ~p.startswith("▼")

    def plain(p: Column) -> Column:
        colons = F.length(p) - F.length(F.replace(p, F.lit(":"), F.lit("")))
        return bound(F.lower(p), lambda low: ~contains_any(low, CLAUSE_NOISE) & ~((colons >= 3) & contains_any(low, ("kg", "l", "링크", "보러가기"))))

    def clauses_of(compact: Column) -> Column:
        # No clause holds what the whole text lacks, so most texts skip the words of advertising.
        suspect = compact.contains(":") | contains_any(F.lower(compact), CLAUSE_NOISE)
        # White space is single spaces by now, but where a link went; runs part clauses, so only the ends of a part are left to trim.
        parts = F.transform(F.split(compact, r"[.!?\n]|\s{2,}"), lambda p: F.btrim(p, F.lit(" -:;,'\"")))
        usable = F.when(suspect, F.filter(parts, lambda p: worded(p) & plain(p))).otherwise(F.filter(parts, worded))
        kept = bound(usable, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(compact)))
        return F.when(compact == "", F.array().cast("array<string>")).otherwise(kept)

    unlinked = lambda t: F.when(t.contains("http"), F.trim(F.regexp_replace(t, r"https?://\S+", ""))).otherwise(t)
    return bound(bound(collapse_space(safe_text(text)), unlinked), clauses_of)


def salient_clauses(clauses: Column, limit: int = 2, issues: Sequence[str] = ISSUE_WORDS, questions: Sequence[str] = QUESTION_WORDS) -> Column:
    """The clauses that say most: long, about an issue, with numbers or questions; each once."""
    marks = [q for q in questions if q.isascii()]
    words = [q for q in questions if not q.isascii()]

    def score(p: Column, i: Column) -> Column:
        told = lambda markers: may_hold(p, markers) & bound(F.lower(p), lambda low: contains_any(low, markers))
        points = (
            F.least(F.length(p), F.lit(120)) / 120.0 + F.when(told(issues), 1.6).otherwise(0.0)
            + F.when(p.rlike(r"\d"), 0.35).otherwise(0.0) + F.when(told(marks) | told(words), 0.5).otherwise(0.0)
        )
        return F.struct((-points).alias("s"), i.alias("i"), p.alias("p"))

    scored = F.transform(clauses, score)
    if limit == 1:
        return F.array_compact(F.array(F.array_min(scored)["p"]))
    # Not array_sort, which compares by an interpreted function.
    return F.slice(F.array_distinct(F.transform(F.sort_array(scored), lambda s: s["p"])), 1, limit)


def combined_text(parts: Sequence[Column]) -> Column:
    """The parts in order, without those that repeat, hold or are held by one before them."""
    if len(parts) < 2:
        return safe_text(parts[0]) if parts else F.lit("")
    texts = F.filter(F.array(*[safe_text(p) for p in parts]), lambda t: t != "")

    def add(kept: Column, t: Column) -> Column:
        told = F.exists(kept, lambda k: k.contains(t) | t.contains(k))
        return F.when(told, kept).otherwise(F.concat(kept, F.array(t)))

    return F.array_join(F.aggregate(texts, F.array().cast("array<string>"), add), " ")


def representative_clause(clauses: Column, sentiment: Column) -> Column:
    """The clause that fits the polarity best: praise without complaint, or the complaint; null without clauses."""
    def fit(low: Column) -> Column:
        add = lambda test, v: F.when(test, F.lit(v)).otherwise(F.lit(0.0))
        praised, pained = contains_any(low, PRAISE_WORDS), contains_any(low, COMPLAINT_WORDS)
        positive = add(praised, 2.2) - add(pained, 1.6) + add(contains_any(low, NO_COMPLAINT), 0.8)
        return F.when(sentiment == "positive", positive).when(sentiment == "negative", add(pained, 2.2)).otherwise(F.lit(0.0))

    def score(p: Column, i: Column) -> Column:
        add = lambda test, v: F.when(test, F.lit(v)).otherwise(F.lit(0.0))
        # Only the poles read the words of a clause.
        read = sentiment.isin("positive", "negative") & may_hold(p, (*PRAISE_WORDS, *COMPLAINT_WORDS, *NO_COMPLAINT))
        polar = F.when(read, bound(F.lower(p), fit)).otherwise(F.lit(0.0))
        points = F.round(F.least(F.length(p), F.lit(120)) / 120.0 + polar + add(p.rlike(r"\d"), 0.2), 9)
        return F.struct((-points).alias("s"), i.alias("i"), p.alias("p"))

    return F.array_min(F.transform(clauses, score))["p"]


def secondary_concern(text: Column, sentiment: Column) -> Column:
    """What a satisfied customer still misses, else an empty string."""

    concern = lambda low: F.coalesce(*[F.when(contains_any(low, markers), note) for markers, note in messages.SECONDARY_CONCERNS], F.lit(""))
    return F.when(sentiment != "positive", "").otherwise(bound(F.lower(safe_text(text)), concern))


def row_summary(field: Callable[[str], Column], points: Column, tags: Column, limit: int = 86) -> Column:
    """One line about a row: its insight, else its points within their context, else its first plain text.

    ``field`` gives the column of a name; columns a table lacks are null. ``points`` and ``tags`` are arrays.
    """
    # All candidates go through one expression; seven copies of it would not fit one compiled method.
    context = F.coalesce(F.nullif(safe_text(F.try_element_at(tags, F.lit(1))), F.lit("")), F.lit(messages.DEFAULT_CONTEXT))
    pointed = F.when(F.size(points) > 0, F.concat(context, F.lit(": "), F.array_join(F.slice(points, 1, 2), ", ")))
    texts = ("nlp_summary", "classification_reason", "opinion_text", "cleaned_text", "text_original", "text_display")
    told = F.array(field("nlp_insight_summary"), pointed, *[field(n) for n in texts])
    told = F.transform(told, lambda t, i: F.struct(safe_text(t).alias("t"), i.alias("i")))
    generic = lambda t: looks_garbled(t) | t.rlike("|".join(messages.GENERIC_PHRASES))
    usable = F.filter(told, lambda x: (x["t"] != "") & ((x["i"] == 1) | ~generic(x["t"])))
    return preview(F.coalesce(F.try_element_at(usable, F.lit(1))["t"], F.lit("")), limit)


def comment_reason(text: Column, stage: Column, sentiment: Column, tokens: Column) -> Column:
    """Sentence that names the stage of the journey and up to two subjects of a comment.

    ``tokens``: words of the text, for comments that hold none of the known subjects.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    topic = F.when(contains_any(low, SMART_WORDS), "사용").otherwise(F.coalesce(F.nullif(stage, F.lit("")), F.lit("기타")))
    subjects = F.array_compact(F.array(*[F.when(contains_any(low, markers), label) for markers, label in SUBJECTS]))
    named = F.when(F.size(subjects) > 0, subjects).otherwise(F.array_distinct(tokens))
    subject = F.coalesce(F.nullif(F.array_join(F.slice(named, 1, 2), ", "), F.lit("")), F.lit(messages.DEFAULT_SUBJECT))
    patterns = messages.SUBJECT_REASONS
    chain = F.when(sentiment == "negative", F.format_string(patterns["negative"], topic, subject)).when(sentiment == "positive", F.format_string(patterns["positive"], topic, subject))
    return chain.otherwise(F.format_string(patterns["neutral"], topic, subject))


def relevance_note(brand: Column, target: Column, kind: Column, score: Column) -> Column:
    """Why a comment counts as relevant: brand, product and kind of opinion, else its score."""
    names = messages.COMMENT_RELEVANCE
    found = F.array_compact(
        F.array(F.when(brand, names["brand"]), F.when(safe_text(target) != "", names["target"]), F.when(F.lower(safe_text(kind)).isin("complaint", "comparison", "preference"), names["kind"]))
    )
    value = F.coalesce(score.cast("double"), F.lit(0.0))
    rest = F.when(value >= 0.45, F.format_string(names["score"], value)).otherwise(names["none"])
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(rest)


def claim_direction(low: Column) -> Column:
    """-1, 0 or 1: which pole the wording leans to."""
    neg, pos = hit_count(low, CLAIM_NEGATIVE), hit_count(low, CLAIM_POSITIVE)
    return F.when(neg > pos, -1).when(pos > neg, 1).otherwise(0)


def problem_signal(corpus: Column, sentiment: Column) -> Column:
    """Kind of problem in a lower-case corpus, by ordered rules; praise wins for positive rows."""
    pained = sentiment.isin("negative", "mixed")
    odor = contains_any(corpus, ODOR_WORDS) & ~contains_any(corpus, ODOR_CLEAR) & (contains_any(corpus, ODOR_NEGATIVE) | pained)
    chain = (
        F.when((sentiment == "positive") & contains_any(corpus, ADVOCACY_WORDS), "advocacy_signal")
        .when(pained & contains_any(corpus, MANUAL_WORDS), "manual_intervention")
        .when(odor, "odor_leakage")
    )
    for name, markers in SIGNALS:
        chain = chain.when(contains_any(corpus, markers), name)
    return chain.otherwise("general_experience")


def action_domain(stage: Column, sentiment: Column, mixed: Column, signal: Column) -> Column:
    """Domain with most points from stage, signal and polarity; ties in the fixed order."""
    def points(test: Column, value: int) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0))

    scores = {d: F.lit(0) for d in DOMAINS}
    for name, weights in STAGE_DOMAINS.items():
        for domain, value in weights:
            scores[domain] = scores[domain] + points(stage == name, value)
    scores["operations / service"] = scores["operations / service"] + points(~stage.isin(*STAGE_DOMAINS), 1) + points(sentiment == "negative", 1)
    for name, (domain, value) in SIGNAL_DOMAINS.items():
        scores[domain] = scores[domain] + points(signal == name, value)
    scores["marketing / message"] = scores["marketing / message"] + points(sentiment == "positive", 1)
    scores["UX / guide"] = scores["UX / guide"] + points(mixed, 1)
    return best_label(scores, -1, F.lit("product"))


def resolution_stage(stage: Column, tags: Column, low: Column, classification: Column, signal: Column) -> Column:
    """Struct of the stage and whether it was inferred from tags, text, signal or class."""
    def tagged(*values: str) -> Column:
        return contains_any(tags, values)

    inferred = (
        F.when(tagged("배송", "설치") | contains_any(low, ("배송", "설치", "방문")), "배송")
        .when(tagged("a/s", "수리", "고객지원", "문의") | (signal == "service_response_gap"), "관리")
        .when(tagged("구독", "계약", "구매 전환") | (signal == "pricing_contract_gap"), "구매")
        .when(tagged("비교", "탐색") | classification.isin("comparison", "informational"), "탐색")
        .when(tagged("추천") | (classification == "preference"), "결정")
        .when(signal.isin("manual_intervention", "odor_leakage", "reliability_failure", "consumable_burden", "onboarding_guide_gap"), "사용")
    )
    direct = F.nullif(F.nullif(F.coalesce(stage, F.lit("")), F.lit("")), F.lit("기타"))
    return F.struct(F.coalesce(direct, inferred, F.lit("")).alias("stage"), (direct.isNull() & inferred.isNotNull()).alias("inferred"))


def resolution_evidence(cards: DataFrame, min_similar: int = 3) -> DataFrame:
    """Signal, stage, domain, evidence and the reasons why evidence may be insufficient, per card.

    Reads the texts, ``sentiment``, ``stage``, ``classification_type``, ``mixed_flag``, ``nlp_context_tags``,
    ``nlp_core_points``, ``similar_evidence`` and ``similar_count`` (``similar.cluster_evidence``) and
    ``video_evidence`` (clauses of the video, ``videos.video_signals``); what is missing counts as empty. A column
    ``representative_clause``, worked out before by the function of that name, spares another reading of the clauses.
    """
    c = F.col
    none = F.array().cast("array<string>")
    words = lambda n: F.coalesce(pick(cards, [n]).cast("array<string>"), none)
    joined = lambda a: F.lower(F.array_join(a, " "))
    text = combined_text([pick(cards, [n], F.lit("")) for n in ("text_original", "translation", "cleaned_text", "text_display") if n in cards.columns])
    corpus = F.concat_ws(" ", F.lower("__text"), joined(words("nlp_context_tags")), joined(words("nlp_core_points")), F.when(c("sentiment") != "positive", joined(words("similar_evidence"))))
    out = cards.withColumn("__text", text)
    out = out.withColumns({"__tags": joined(words("nlp_context_tags")), "__corpus": corpus, "__low": F.lower("__text")})
    out = out.withColumn("signal_name", problem_signal(c("__corpus"), c("sentiment")))
    known = "representative_clause" in cards.columns
    clause = F.coalesce(c("representative_clause") if known else representative_clause(split_clauses(c("__text")), c("sentiment")), F.lit(""))
    out = out.withColumns(
        {
            "__stage": resolution_stage(c("stage"), c("__tags"), c("__low"), F.coalesce(c("classification_type"), F.lit("")), c("signal_name")),
            "representative_evidence": preview(clause, 82),
            "similar_evidence": words("similar_evidence"),
            "secondary_concern": secondary_concern(c("__text"), c("sentiment")),
        }
    )
    around = F.filter(F.transform(words("video_evidence"), lambda v: preview(v, 82)), lambda v: (v != "") & (v != c("representative_evidence")))
    mixed = F.coalesce("mixed_flag", F.lit(False)) | (c("sentiment") == "mixed")
    missing = {
        "journey_stage_missing": c("__stage.stage") == "",
        "journey_stage_inferred_fallback": c("__stage.inferred"),
        "representative_evidence_missing": c("representative_evidence") == "",
        "similar_signal_lt_3": F.coalesce("similar_count", F.lit(0)) < min_similar,
    }
    out = out.withColumns(
        {
            "resolved_stage": c("__stage.stage"), "stage_inferred": c("__stage.inferred"),
            "action_domain": action_domain(c("__stage.stage"), c("sentiment"), mixed, c("signal_name")),
            "context_evidence": F.coalesce(F.try_element_at(around, F.lit(1)), F.lit("")),
            "insufficient_reasons": F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in missing.items()])),
        }
    )
    out = out.withColumn("insufficient_evidence", F.size("insufficient_reasons") > 0)
    return out.drop("__text", "__tags", "__corpus", "__low", "__stage")


def issue_strength(df: DataFrame, keywords: Column) -> Column:
    """Struct of the strength level and score of a card in [0.05, 0.99]."""
    c = F.col
    strength = pick(df, ["signal_strength"], F.lit(""))
    likes = F.coalesce(pick(df, ["like_count"]).cast("double"), F.lit(0.0))
    size = F.coalesce(pick(df, ["cluster_size"]).cast("double"), F.lit(1.0))
    score = (
        F.lit(0.28) + F.when(c("sentiment_label") == "negative", 0.22).when(c("sentiment_label") == "positive", 0.16).otherwise(0.1)
        + F.when(strength == "strong", 0.16).when(strength == "medium", 0.09).when(strength == "weak", 0.03).otherwise(0.0)
        + F.when(pick(df, ["inquiry_flag"], F.lit(False)), 0.06).otherwise(0.0) + F.when(pick(df, ["numeric_flag"], F.lit(False)), 0.04).otherwise(0.0)
        + F.least(F.lit(0.14), size / 180.0) + F.least(F.lit(0.08), likes / 300.0)
        + F.when(F.size(keywords) > 0, 0.05).otherwise(0.0) + F.when(F.size(keywords) >= 3, 0.03).otherwise(0.0)
        + F.when(contains_any(F.lower(safe_text(pick(df, ["text_display", "cleaned_text"], F.lit("")))), SEVERE_WORDS), 0.07).otherwise(0.0)
    )
    value = F.round(clamp(score, 0.05, 0.99), 6)
    high, middle, low = messages.STRENGTH_LEVELS
    return F.struct(F.when(value >= 0.72, high).when(value >= 0.52, middle).otherwise(low).alias("level"), value.alias("score"))


def voc_items(text: Column, sentiment: Column, limit: int = 4) -> Column:
    """Subjects a comment speaks of, in the order of the rules: array of ``topic, sentiment, insight, evidence_span``.

    The evidence is the first listed phrase of a topic, as the text writes it. A text without any phrase has one
    weak item with its beginning.
    """
    label = F.when(sentiment == "negative", "부정").when(sentiment == "positive", "긍정").otherwise("중립")

    def item(topic: str, insight: str, span: Column) -> Column:
        return F.struct(F.lit(topic).alias("topic"), label.alias("sentiment"), F.lit(insight).alias("insight"), span.alias("evidence_span"))

    def items(source: Column, lowered: Column) -> Column:
        every = F.array(*[item(t, i, written_phrase(source, lowered, p)) for t, p, i in messages.VOC_TOPICS])
        other = F.array(item(*messages.VOC_OTHER, F.substring(source, 1, 30)))
        return bound(F.filter(every, lambda x: x["evidence_span"] != ""), lambda found: F.when(F.size(found) > 0, F.slice(found, 1, limit)).otherwise(other))

    return bound(safe_text(text), lambda source: bound(F.lower(source), lambda lowered: items(source, lowered)))


def inquiry_flag(known: Column, text: Column) -> Column:
    """A flag that an earlier step set, else question marks and question words."""
    return F.coalesce(known, F.lit(False)) | text.contains("?") | contains_any(F.lower(text), INQUIRY_WORDS)


def quantitative_flag(known: Column, text: Column) -> Column:
    """A flag that an earlier step set, else a number together with a unit or a question of amount."""
    low = F.lower(text)
    return F.coalesce(known, F.lit(False)) | (text.rlike(r"\d") & (contains_any(low, AMOUNT_UNITS) | contains_any(low, AMOUNT_WORDS)))


def reason_conflicts(reason: Column, sentiment: Column) -> Column:
    """The reason given for a label leans to the other pole."""
    low = F.lower(safe_text(reason))
    neg, pos = hit_count(low, REASON_NEGATIVE), hit_count(low, REASON_POSITIVE)
    return ((sentiment == "positive") & (neg > pos)) | ((sentiment == "negative") & (pos > neg))


def refined_aspect(label: Column, tags: Column, text: Column) -> Column:
    """The aspect that the first known tag names; else the label if it says something; else what the text names."""
    clean = safe_text(label)
    named = F.create_map(*[F.lit(x) for pair in TAG_ASPECTS.items() for x in pair])
    by_tag = F.try_element_at(F.filter(F.transform(tags, lambda t: F.element_at(named, safe_text(t))), lambda a: a.isNotNull()), F.lit(1))
    low = F.lower(text)
    generic = (clean == "") | F.lower(clean).isin("general", "기타", "other", "대표 코멘트") | F.lower(clean).rlike(r"^(이슈\s*\d+|issue\s*\d+)$")
    by_text = F.coalesce(*[F.when(contains_any(low, markers), aspect) for markers, aspect in TEXT_ASPECTS], F.lit("Product Experience"))
    return F.coalesce(by_tag, F.when(~generic, clean), by_text)


def aspect_label(label: Column) -> Column:
    clean = safe_text(label)
    names = F.create_map(*[F.lit(x) for pair in display.ASPECT_LABEL_KO.items() for x in pair])
    return F.when(clean == "", "제품 경험").otherwise(F.coalesce(F.element_at(names, clean), clean))


def comment_showcase(df: DataFrame, sentiment: str, limit: int = 30) -> DataFrame:
    """The most telling comments of one polarity by the showcase score. All comments are ranked."""
    scored = showcase_scores(df, sentiment)
    return scored.orderBy(F.col("showcase_score").desc(), F.coalesce("like_count", F.lit(0)).desc(), "comment_id").limit(limit)


def showcase_scores(df: DataFrame, sentiment: str) -> DataFrame:
    """Valid comments of one polarity, once each, with ``showcase_score``."""
    c = F.col
    label = F.lower(F.coalesce(pick(df, ["sentiment_final", "sentiment_label"], F.lit("neutral")), F.lit("neutral")))
    valid = pick(df, ["comment_validity"], F.lit("valid")) == "valid"
    hygiene = F.lower(F.coalesce(pick(df, ["hygiene_class"], F.lit("strategic")), F.lit("")))
    likes, length = F.coalesce(c("like_count"), F.lit(0)), F.coalesce(c("text_length"), F.lit(0))
    score, rep = F.coalesce(c("sentiment_score"), F.lit(0.0)), F.coalesce(pick(df, ["representative_score"], F.lit(0)), F.lit(0))
    pool = df.where(valid & (hygiene != "trash") & (label == sentiment))
    signed = -score * 100 if sentiment == "negative" else score * 100 if sentiment == "positive" else F.abs(score) * 100
    return pool.withColumn("showcase_score", F.round(signed + likes * 1.5 + length * 0.04 + rep * 2, 9)).dropDuplicates(["comment_id"])


def bundle_showcase(df: DataFrame, sentiment: str, key: Sequence[str], limit: int = 5, samples: int = 5) -> DataFrame:
    """One showcase row per cluster key with the size of the cluster and its best-liked samples."""
    c = F.col
    pool = df.where((pick(df, ["comment_validity"], F.lit("valid")) == "valid") & (c("sentiment_label") == sentiment))
    sizes = pool.groupBy(*key).agg(F.count("*").alias("cluster_size"))
    order = [c("like_count").desc_nulls_last(), c("text_length").desc_nulls_last(), c("comment_id")]
    best = top_per_group(pool, key, order, samples, "__rank").groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__rank", "comment_id"))), lambda s: s["comment_id"]).alias("samples")
    )
    first = top_per_group(showcase_scores(df, sentiment), key, [c("showcase_score").desc(), c("comment_id")], 1)
    out = first.join(sizes, list(key)).join(best, list(key))
    return out.orderBy(c("showcase_score").desc(), "comment_id").limit(limit)


def enrich_cards(cards: DataFrame, source: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fill blank fields of cards from their source row: by opinion id, else by comment id, else by link."""
    names = ("opinion_id", "source_content_id", "video_link")
    out = cards
    for i, key in enumerate(names):
        if key not in source.columns or key not in cards.columns:
            continue
        one = top_per_group(source.where(F.coalesce(key, F.lit("")) != ""), [key], [F.col("source_content_id")], 1)
        out = out.join(one.select(key, *[F.col(f).alias(f"__{i}_{f}") for f in fields]), key, "left")
    for f in fields:
        found = [F.nullif(F.col(f"__{i}_{f}").cast("string"), F.lit("")) for i in range(len(names)) if f"__{i}_{f}" in out.columns]
        own = F.nullif(F.col(f).cast("string"), F.lit("")) if f in cards.columns else F.lit(None)
        out = out.withColumn(f, F.coalesce(own, *found, F.lit("")))
    return out.drop(*[n for n in out.columns if n.startswith("__")])
