"""Markers for comment classification."""

from __future__ import annotations

# These word lists, patterns and weights must hold for results to be right.
# Every operator takes them as parameters, so other rule tables can be passed in.

AGREEMENT_MARKERS = (
    "i agree", "agree with", "exactly", "same", "true that", "right", "100%", "동의", "저도 그렇게 생각", "맞아요",
    "맞는 말",
)

SHORT_DEPENDENT_MARKERS = ("i agree", "same", "exactly", "동의", "맞아요", "그렇게 생각해요")

COMPARISON_MARKERS = (
    "better", "worse", "than", "prefer", "compared to", "versus", "vs", "더 낫", "더 좋", "비교", "보다", "선호",
)

PREFERENCE_MARKERS = ("prefer", "better", "would choose", "i like", "personally", "선호", "더 좋", "개인적으로", "저는")

STRONG_NEGATIVE_MARKERS = (
    "bad", "terrible", "awful", "hate", "broken", "broke", "doesn't work", "doesnt work", "problem",
    "issue", "issues", "frustrating", "disappointed", "waste", "useless", "poor", "worst", "failed",
    "failure", "annoying", "inconvenient", "complaint", "고장", "불만", "문제", "답답", "별로", "실망", "최악", "나쁘",
    "안 된다", "안돼", "불편", "수리", "에러",
)

STRONG_POSITIVE_MARKERS = (
    "good", "great", "excellent", "love", "recommend", "satisfied", "works great", "very good", "best",
    "amazing", "perfect", "happy with", "만족", "추천", "좋아요", "매우 좋", "최고", "잘 된다", "좋네요",
)

INFORMATIONAL_MARKERS = (
    "how to", "because", "means", "in case", "for example", "usually", "diagnostic", "repair",
    "maintenance", "설명", "정보", "원인", "방법", "예를 들면", "보통",
)

EMOTIONAL_ONLY_MARKERS = (
    "nightmares", "scary", "funny", "hilarious", "lol", "lmao", "haha", "무서웠", "웃기네", "ㅔㅔ", "ㅋㅋ", "후덜덜",
)

CHANNEL_FEEDBACK_MARKERS = (
    "video", "videos", "channel", "creator", "youtuber", "youtube", "editing", "edit", "thumbnail", "host",
    "reviewer", "영상", "채널", "유튜브", "편집", "썬네일", "진행", "진행자", "리뷰어", "크리에이터", "설명 잘", "영상미",
)

GENERIC_POSITIVE_ONLY_MARKERS = (
    "good", "great", "nice", "awesome", "amazing", "best", "love it", "thanks", "thank you", "좋아요", "좋네요",
    "좋네", "최고", "감사", "감사합니다", "굿", "대박",
)

INQUIRY_MARKERS = (
    "문의", "어떻게", "어디", "왜", "무엇", "뭐", "인가요", "맞나요", "가능할까요", "가능한가요", "되나요", "알려", "질문", "how", "where",
    "why", "what", "can i", "could i", "does it", "is it", "anyone know",
)

PRODUCT_MARKERS = (
    "washer", "washing machine", "dryer", "refrigerator", "fridge", "dishwasher", "drum", "top load",
    "top-load", "smart", "ai", "digital", "noise", "repair", "clean", "wash", "service", "support",
    "delivery", "shipping", "price", "design", "performance", "maintenance", "세탁기", "건조기", "냉장고", "식기세척기",
    "드럼", "통돌이", "스마트", "소음", "세척", "수리", "배송", "서비스", "가격", "디자인",
)

TARGET_PATTERNS = {
    "drum_washer": ("drum washer", "drum washers", "drum", "드럼", "드럼 세탁기"),
    "top_load_washer": ("top load", "top-load", "top loader", "통돌이", "통돌이 세탁기"),
    "washer": ("washer", "washing machine", "세탁기"),
    "dryer": ("dryer", "건조기"),
    "refrigerator": ("refrigerator", "fridge", "냉장고"),
    "dishwasher": ("dishwasher", "식기세척기"),
}

TARGET_LABELS = {
    "drum_washer": "드럼 세탁기", "top_load_washer": "통돌이 세탁기", "washer": "세탁기", "dryer": "건조기",
    "refrigerator": "냉장고", "dishwasher": "식기세척기",
}

VIDEO_TYPE_PATTERNS = {
    "promotional": ("할인", "프로모션", "세일", "특가", "쿠팡", "최저가", "이벤트", "sale", "deal", "discount", "coupon"),
    "review": ("리뷰", "후기", "사용기", "솔직", "장단점", "review", "honest", "pros and cons"),
    "comparison": ("비교", "vs", "대결", "차이", "comparison", "versus", "which is better"),
    "unboxing": ("언박싱", "개봉기", "unboxing", "first look"),
    "tutorial": ("설치", "사용법", "설명", "how to", "tutorial", "guide", "방법"),
    "official": ("공식", "official", "광고", "제조사"),
}

INSIGHT_TYPE_MAP = {
    ("promotional", "complaint"): "상품구성_피드백", ("promotional", "preference"): "구매전환_증거",
    ("promotional", "informational"): "구매_문의", ("review", "complaint"): "품질_불만",
    ("review", "preference"): "만족_포인트", ("comparison", "complaint"): "경쟁사_비교",
    ("comparison", "preference"): "경쟁사_비교", ("comparison", "comparison"): "경쟁사_비교",
    ("tutorial", "complaint"): "사용성_불만", ("tutorial", "informational"): "사용_팁",
    ("official", "complaint"): "품질_불만", ("official", "preference"): "브랜드_신뢰",
}

PURCHASE_KEYWORDS = ("구매", "샀", "샀어", "주문", "결제", "bought", "purchased", "ordered")

CEJ_STAGE_KEYWORDS = {
    "인지": ("추천", "비교", "광고", "리뷰", "후기", "review", "compare", "worth", "브랜드"),
    "구매": ("구매", "결제", "가격", "할인", "쿠폰", "사은품", "order", "buy", "price", "deal"),
    "배송": ("배송", "도착", "출고", "shipping", "delivery", "late", "delay"),
    "설치": ("설치", "기사", "방문", "installation", "install", "setup", "mount"),
    "사용준비": ("설명서", "연결", "앱", "등록", "와이파이", "초기", "manual", "connect", "wifi", "app"),
    "사용": ("사용", "소음", "냄새", "성능", "세척", "건조", "세탁", "불편", "works", "noise", "smell", "performance"),
    "관리교체": ("청소", "필터", "교체", "수리", "as", "서비스", "관리", "clean", "replace", "repair", "service"),
}

BRAND_PATTERNS = {
    "삼성": ("삼성", "samsung", "비스포크", "bespoke"),
    "LG": ("lg", "엘지", "트롬", "오브제"),
    "월풀": ("whirlpool",),
    "GE": ("ge", "ge profile"),
    "보쉬": ("bosch",),
    "키친에이드": ("kitchenaid",),
    "메이태그": ("maytag",),
}
