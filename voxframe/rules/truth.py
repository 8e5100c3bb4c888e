"""Taxonomy of journey stages and judgment axes."""

from __future__ import annotations

# These word lists, patterns and weights must hold for results to be right.
# Every operator takes them as parameters, so other rule tables can be passed in.

JOURNEY_STAGES = (
    "awareness", "exploration", "purchase", "decision", "delivery", "onboarding", "usage", "maintenance",
    "replacement",
)

JUDGMENT_AXES = (
    "price_value_fit", "installation_space_fit", "maintenance_burden", "automation_convenience",
    "durability_lifespan", "brand_trust", "usage_pattern_fit", "comparison_substitute_judgment",
    "design_interior_fit", "service_after_sales", "purchase_strategy_contract",
    "repurchase_recommendation",
)

JOURNEY_ALIASES = {
    "awareness": "awareness", "aware": "awareness", "s1 aware": "awareness", "exploration": "exploration",
    "explore": "exploration", "s2 explore": "exploration", "purchase": "purchase",
    "s4 purchase": "purchase", "decision": "decision", "decide": "decision", "delivery": "delivery",
    "deliver": "delivery", "installation": "delivery", "install": "delivery", "s5 deliver": "delivery",
    "onboarding": "onboarding", "on-board": "onboarding", "onboard": "onboarding",
    "s6 on-board": "onboarding", "usage": "usage", "use": "usage", "s7 use": "usage",
    "maintenance": "maintenance", "maintain": "maintenance", "s8 maintain": "maintenance",
    "replacement": "replacement", "replace": "replacement", "s9 replace": "replacement", "인지": "awareness",
    "탐색": "exploration", "구매": "purchase", "결정": "decision", "배송": "delivery", "사용준비": "onboarding",
    "사용": "usage", "관리": "maintenance", "교체": "replacement",
}

JOURNEY_MARKERS = {
    "awareness": ("광고", "썸네일", "처음 알게", "ad", "advertisement", "thumbnail", "sponsored"),
    "exploration": ("비교", "후기", "추천", "고민", "review", "compare", "comparison", "vs"),
    "purchase": (
        "구매", "주문", "결제", "구독", "렌탈", "할부", "약정", "purchase", "order", "checkout", "contract",
        "subscription",
    ),
    "decision": ("결정", "선택", "포기", "장바구니", "decide", "decision", "choose", "final"),
    "delivery": ("배송", "설치", "방문", "파손", "지연", "delivery", "shipping", "installation", "install"),
    "onboarding": (
        "초기 설정", "설정", "등록", "연동", "로그인", "사용법", "setup", "set up", "register", "pairing", "wifi", "app",
        "thinq", "manual",
    ),
    "usage": ("사용", "성능", "세탁력", "음식물", "소음", "냄새", "use", "usage", "performance", "noise", "odor"),
    "maintenance": (
        "관리", "청소", "필터", "a/s", "as", "서비스", "수리", "센터", "repair", "service", "warranty", "maintenance",
    ),
    "replacement": ("교체", "바꾸", "처분", "재구매", "replace", "replacement", "trade in", "repurchase"),
}

AXIS_MARKERS = {
    "price_value_fit": ("가격", "비싸", "가성비", "총비용", "가격 대비", "price", "cost", "value", "expensive", "budget"),
    "installation_space_fit": ("설치", "공간", "자리", "크기", "깊이", "폭", "installation", "space", "fit", "clearance"),
    "maintenance_burden": ("필터", "교체", "청소", "세척", "소모품", "냄새", "진득", "maintenance", "cleaning", "filter", "odor"),
    "automation_convenience": (
        "자동", "편의", "불편", "조작", "버튼", "앱", "automation", "automatic", "convenience", "usability", "setup",
    ),
    "durability_lifespan": ("고장", "불량", "내구", "수명", "파손", "broken", "durability", "lifespan", "failure"),
    "brand_trust": ("브랜드", "신뢰", "믿음", "trust", "brand", "reliability"),
    "usage_pattern_fit": ("대가족", "소량", "야간", "매일", "주말", "패턴", "night", "daily", "family", "habit", "pattern"),
    "comparison_substitute_judgment": ("비교", "대체", "vs", "comparison", "alternative", "compared", "통돌이", "드럼"),
    "design_interior_fit": ("디자인", "인테리어", "색상", "마감", "design", "interior", "aesthetic", "look"),
    "service_after_sales": ("a/s", "as", "서비스", "센터", "기사", "접수", "응대", "after sales", "repair", "warranty"),
    "purchase_strategy_contract": (
        "구독", "렌탈", "약정", "할부", "해지", "위약금", "계약", "contract", "subscription", "rental", "installment",
    ),
    "repurchase_recommendation": ("추천", "재구매", "지인", "다시 살", "recommend", "repurchase", "buy again", "word of mouth"),
}

BRAND_ENTITY_MARKERS = ("lg", "samsung", "ge", "whirlpool", "midea", "brand", "브랜드")

BRAND_TRUST_CUES = ("신뢰", "믿음", "브랜드", "trust", "reliability", "brand reputation")

TOPIC_TO_AXIS = {
    "performance": "automation_convenience", "convenience/usability": "automation_convenience",
    "reliability/breakdown": "durability_lifespan", "delivery/installation": "installation_space_fit",
    "app/connectivity": "automation_convenience", "maintenance/cleaning": "maintenance_burden",
    "a/s & support": "service_after_sales", "price/value": "price_value_fit",
    "design/build": "design_interior_fit",
}

CLASSIFICATION_TO_AXIS = {
    "comparison": "comparison_substitute_judgment", "preference": "repurchase_recommendation",
    "complaint": "maintenance_burden",
}

TRASH_QUALITY_SET = ("ad", "tagging_only", "meaningless", "repetitive", "generic_engagement", "low_context")

INQUIRY_NOISE_PATTERNS = (
    "https?://", r"\baffiliate\b", r"\bsponsor(?:ed|ing)?\b", r"\bpromo\s*code\b", r"\bdiscount\s*code\b",
    r"\bcoupon\b", r"\bcoupang\s*partners?\b", r"\bjoint\s*purchase\b", r"\binvestment\b", r"\bstock\w*\b",
    r"\brestock\w*\b", r"\bin\s+stock\b", r"\bout\s+of\s+stock\b", r"\bsubscribe\s*event\b",
)

NON_CUSTOMER_VOICE_PATTERNS = (
    r"don't\s+even\s+have", r"do\s+not\s+even\s+have", r"just\s+good\s+content", r"watching\s+for\s+fun",
    r"not\s+using\s+this\s+product", r"제품\s+없", r"사용\s+안\s+해", "시청만", r"\bnot\s+a\s+user\b",
    r"\bnot\s+an?\s+owner\b",
)

REAL_INQUIRY_MARKERS = (
    "어떻게", "어디", "왜", "가능", "문의", "비교", "추천", "설치", "고장", "수리", "환불", "교체", "어떤", "얼마", "몇", "되나요", "인가요",
    "까요", "how", "why", "where", "which", "can i", "should i", "does it", "is it", "repair", "install",
    "price", "cost",
)

REAL_DECISION_USAGE_MARKERS = (
    "고장", "수리", "설치", "교체", "환불", "비용", "가격", "비교", "추천", "사용", "as", "a/s", "repair", "install",
    "replacement", "warranty", "price", "cost",
)

NON_INQUIRY_NARRATIVE_PATTERNS = (
    r"\bi used to\b", r"\bi can still remember\b", r"\bi noticed years ago\b", r"\bi'd like to share\b",
    r"\bthought i'd share\b", r"\bgreat video\b", r"\bthank(s| you)\b", r"\btip\b", r"\bstock\w*\b",
    r"\brestock\w*\b", r"\bin\s+stock\b", r"\bout\s+of\s+stock\b",
)
