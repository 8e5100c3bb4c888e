"""Display label maps."""

from __future__ import annotations

# These word lists, patterns and weights must hold for results to be right.
# Every operator takes them as parameters, so other rule tables can be passed in.

PRODUCT_TARGET_KR_MAP = {
    "refrigerator": "냉장고", "washer": "세탁기", "dryer": "건조기", "dishwasher": "식기세척기", "drum_washer": "드럼세탁기",
    "top_load_washer": "통돌이세탁기", "air_conditioner": "에어컨", "microwave": "전자레인지", "vacuum": "청소기",
    "styler": "스타일러",
}

PRODUCT_LABEL_ALIASES = {
    "가전": "가전제품", "가전제품": "가전제품", "냉장고": "냉장고", "세탁기": "세탁기", "건조기": "건조기", "식기세척기": "식기세척기",
    "식세기": "식기세척기", "청소기": "청소기", "오븐": "오븐", "정수기": "정수기", "인덕션": "인덕션", "와인셀러": "와인셀러", "컵세척기": "컵세척기",
    "실내식물재배기": "실내식물재배기(틔운)", "틔운": "실내식물재배기(틔운)",
}

BRAND_CANONICAL_MAP = {
    "lg": "LG", "l.g": "LG", "엘지": "LG", "samsung": "Samsung", "삼성": "Samsung", "ge": "GE", "g.e": "GE",
    "지이": "GE", "general electric": "GE", "whirlpool": "Whirlpool", "월풀": "Whirlpool",
}

CEJ_CANONICAL_MAP = {
    "awareness": "인지", "aware": "인지", "exploration": "탐색", "explore": "탐색", "decision": "결정",
    "decide": "결정", "purchase": "구매", "delivery": "배송", "deliver": "배송", "installation": "배송",
    "install": "배송", "onboarding": "사용준비", "on-board": "사용준비", "onboard": "사용준비", "usage": "사용",
    "use": "사용", "maintenance": "관리", "maintain": "관리", "replacement": "교체", "replace": "교체",
    "other": "기타", "설치": "배송", "관리교체": "관리",
}

CEJ_ORDER = ("인지", "탐색", "결정", "구매", "배송", "사용준비", "사용", "관리", "교체", "기타")

REGION_LABELS = {
    "KR": "한국", "US": "미국",
}

REGION_OTHER_LABEL = "그 외"

SENTIMENT_LABELS = {
    "positive": "긍정", "negative": "부정", "neutral": "중립", "excluded": "제외",
}

ASPECT_LABEL_KO = {
    "A/S & Support": "A/S·고객지원", "Performance": "성능", "Convenience/Usability": "사용 편의", "Cost": "가격/비용",
    "Delivery/Install": "배송/설치", "Durability": "내구성", "Product Experience": "제품 경험", "General": "제품 경험",
}

AXIS_KO = {
    "price_value_fit": "가격/가치 적합성", "installation_space_fit": "설치/공간 적합성", "maintenance_burden": "유지관리 부담",
    "automation_convenience": "자동화/편의성", "durability_lifespan": "내구성/수명", "brand_trust": "브랜드 신뢰",
    "usage_pattern_fit": "사용 패턴 적합성", "comparison_substitute_judgment": "비교/대체재 판단",
    "design_interior_fit": "디자인/인테리어 적합성", "service_after_sales": "서비스/A·S",
    "purchase_strategy_contract": "구매전략/계약", "repurchase_recommendation": "재구매/추천 의향",
}

STAGE_KO = {
    "awareness": "인지", "exploration": "탐색", "purchase": "구매", "decision": "결정", "delivery": "배송",
    "onboarding": "사용준비", "usage": "사용", "maintenance": "관리", "replacement": "교체",
}

ACTION_DOMAIN_BY_AXIS = {
    "price_value_fit": "business / policy", "installation_space_fit": "product",
    "maintenance_burden": "product", "automation_convenience": "UX / guide",
    "durability_lifespan": "product", "brand_trust": "marketing / message",
    "usage_pattern_fit": "UX / guide", "comparison_substitute_judgment": "marketing / message",
    "design_interior_fit": "product", "service_after_sales": "operations / service",
    "purchase_strategy_contract": "business / policy", "repurchase_recommendation": "marketing / message",
}

ACTION_LABEL_KO = {
    "immediate_fix": "즉시 조치", "monitor": "모니터링", "product_improvement": "제품 개선",
    "service_operation": "서비스 운영", "marketing_message": "메시지/전달 개선", "maintain_strength": "강점 유지",
}

PRIORITY_RANK = {
    "High": 3, "Medium": 2, "Low": 1,
}

IMPACT_RANK = {
    "High": 3, "Medium": 2, "Low": 1,
}
