"""Rule tables of the topic plan."""

from __future__ import annotations

# These word lists, patterns and weights must hold for results to be right.
# Every operator takes them as parameters, so other rule tables can be passed in.

BRAND_TOKENS = ("lg", "samsung", "whirlpool", "ge", "dyson", "삼성", "엘지", "미디어")

PRODUCT_TOKENS = (
    "냉장고", "세탁기", "건조기", "식기세척기", "dishwasher", "washer", "dryer", "fridge", "refrigerator", "틔운", "티운",
    "tiiun", "듀오보", "duobo", "오브제", "objet", "비스포크", "bespoke",
)

POSITIVE_TOKENS = ("좋", "만족", "편리", "추천", "최고", "good", "great", "helpful", "amazing", "works well", "love")

NEGATIVE_TOKENS = (
    "비싸", "불편", "문제", "고장", "느리", "소음", "진동", "불만", "별로", "오류", "bad", "worst", "cloudy", "slow", "broken",
    "hate", "issue",
)

SIGNAL_JOURNEY_MARKERS = {
    "awareness": ("광고", "브랜드", "처음", "awareness", "brand"),
    "exploration": ("비교", "리뷰", "탐색", "찾아", "explore", "review", "compare"),
    "purchase": ("가격", "구매", "결제", "계약", "buy", "purchase", "price"),
    "decision": ("결정", "선택", "고민", "decide", "decision", "choose"),
    "delivery": ("배송", "설치", "방문", "delivery", "install"),
    "onboarding": ("초기 설정", "연동", "가입", "onboard", "setup", "pairing"),
    "usage": ("사용", "성능", "작동", "usage", "performance", "work"),
    "maintenance": ("관리", "청소", "필터", "수리", "서비스", "a/s", "maintenance", "repair"),
    "replacement": ("교체", "재구매", "바꾸", "replace", "replacement"),
}

SIGNAL_AXIS_MARKERS = {
    "price_value_fit": (
        ("가격", 1.0),
        ("비싸", 1.0),
        ("가성비", 1.0),
        ("비용", 0.8),
        ("price", 1.0),
        ("value", 0.8),
        ("expensive", 1.0),
        ("cost", 0.8),
    ),
    "installation_space_fit": (
        ("설치", 1.0),
        ("공간", 1.0),
        ("크기", 0.8),
        ("자리", 0.8),
        ("install", 1.0),
        ("space", 1.0),
        ("size", 0.8),
    ),
    "maintenance_burden": (
        ("관리", 1.0),
        ("청소", 1.0),
        ("필터", 1.0),
        ("세제", 0.8),
        ("maintenance", 1.0),
        ("clean", 1.0),
        ("detergent", 1.0),
        ("rinse aid", 0.9),
    ),
    "automation_convenience": (
        ("자동", 1.0),
        ("편의", 1.0),
        ("버튼", 0.8),
        ("ui", 0.8),
        ("ux", 0.8),
        ("easy", 1.0),
        ("convenient", 1.0),
        ("setting", 0.8),
    ),
    "durability_lifespan": (
        ("고장", 1.0),
        ("내구", 1.0),
        ("수명", 1.0),
        ("durable", 1.0),
        ("broken", 1.0),
        ("lifespan", 1.0),
        ("reliable", 0.8),
    ),
    "brand_trust": (
        ("브랜드", 1.0),
        ("신뢰", 1.0),
        ("회사", 0.8),
        ("brand", 1.0),
        ("trust", 1.0),
        ("reputation", 0.8),
    ),
    "usage_pattern_fit": (
        ("사용", 1.0),
        ("패턴", 1.0),
        ("가족", 0.7),
        ("생활", 0.7),
        ("usage", 1.0),
        ("daily", 0.8),
        ("habit", 0.7),
    ),
    "comparison_substitute_judgment": (
        ("비교", 1.0),
        ("대체", 1.0),
        ("vs", 1.0),
        ("compare", 1.0),
        ("alternative", 1.0),
        ("instead", 0.9),
        ("rather than", 0.9),
    ),
    "design_interior_fit": (
        ("디자인", 1.0),
        ("인테리어", 1.0),
        ("색상", 0.8),
        ("외관", 0.8),
        ("design", 1.0),
        ("interior", 1.0),
        ("look", 0.7),
    ),
    "service_after_sales": (
        ("서비스", 1.0),
        ("a/s", 1.0),
        ("센터", 0.9),
        ("service", 1.0),
        ("after sales", 1.0),
        ("support", 1.0),
        ("sla", 1.0),
        ("repair", 0.9),
    ),
    "purchase_strategy_contract": (
        ("계약", 1.0),
        ("할인", 0.9),
        ("구매", 0.8),
        ("구독", 1.0),
        ("promotion", 0.8),
        ("contract", 1.0),
        ("discount", 0.9),
    ),
    "repurchase_recommendation": (
        ("재구매", 1.0),
        ("추천", 0.8),
        ("다시 산다", 1.0),
        ("repurchase", 1.0),
        ("recommend", 0.8),
    ),
}

NAMED_PRODUCT_ALIASES = (
    (
        "tiiun",
        ("틔운", "티운", "tiiun", "tuiun", "ti-uun"),
    ),
    (
        "duobo",
        ("듀오보", "duobo", "duo-bo"),
    ),
)

PRODUCT_LINE_ALIASES = (
    (
        "objet",
        ("오브제", "objet", "objet collection"),
    ),
    (
        "bespoke",
        ("비스포크", "bespoke"),
    ),
)

PRODUCT_CATEGORY_ALIASES = (
    (
        "dishwasher",
        ("식기세척기", "dishwasher", "dish washer"),
    ),
    (
        "washer",
        ("세탁기", "washing machine", "washer"),
    ),
    (
        "dryer",
        ("건조기", "dryer"),
    ),
    (
        "refrigerator",
        ("냉장고", "김치냉장고", "refrigerator", "fridge"),
    ),
    (
        "plant_care_device",
        ("식물관리기", "plant care", "틔운", "티운", "tiiun"),
    ),
    (
        "coffee_machine",
        ("커피머신", "coffee machine", "듀오보", "duobo"),
    ),
    (
        "air_conditioner",
        ("에어컨", "air conditioner", "ac"),
    ),
    (
        "vacuum_cleaner",
        ("청소기", "vacuum"),
    ),
)

NAMED_TO_CATEGORY = {
    "tiiun": "plant_care_device", "duobo": "coffee_machine",
}

GENERIC_STOPWORDS = (
    "the", "and", "but", "for", "with", "that", "this", "have", "has", "had", "just", "very", "really",
    "video", "dishwasher", "washers", "washer", "machine", "using", "used", "user", "users", "good",
    "great", "nice", "thanks", "thank", "it", "to", "my", "you", "your", "our", "we", "they", "is", "are",
    "was", "were", "what", "why", "how", "who", "when", "where", "please", "help", "제품", "사용", "영상", "정말",
    "너무", "그냥", "완전", "진짜", "그리고", "하지만", "그래서",
)

TOKEN_NORMALIZATION = {
    "repairs": "repair", "repairing": "repair", "service": "service", "servicing": "service",
    "cleaning": "clean", "cleaned": "clean", "filters": "filter", "detergents": "detergent", "pods": "pod",
    "costs": "cost", "prices": "price", "expensive": "price", "cheaper": "price", "delivery": "delivery",
    "install": "installation", "installed": "installation",
}

AXIS_KEYWORDS = {
    "service_after_sales": ("service", "support", "repair", "a/s", "sla", "as"),
    "maintenance_burden": ("filter", "clean", "detergent", "rinse aid", "maintenance", "smell"),
    "automation_convenience": ("button", "ui", "ux", "setup", "easy", "convenient", "workflow"),
    "comparison_substitute_judgment": ("compare", "vs", "versus", "alternative", "instead", "rather than"),
    "price_value_fit": ("price", "cost", "expensive", "cheap", "value"),
}

ISSUE_AXIS_LABEL = {
    "price_value_fit": "가격-가치 불일치", "installation_space_fit": "설치/공간 제약", "maintenance_burden": "유지관리 부담",
    "automation_convenience": "자동화 편의성", "durability_lifespan": "내구성 리스크", "brand_trust": "브랜드 신뢰",
    "usage_pattern_fit": "사용패턴 적합성", "comparison_substitute_judgment": "비교/대체 판단",
    "design_interior_fit": "디자인 적합성", "service_after_sales": "서비스/A/S",
    "purchase_strategy_contract": "구매전략/계약", "repurchase_recommendation": "재구매 의향",
}

STAGE_LABEL = {
    "awareness": "인지", "exploration": "탐색", "purchase": "구매", "decision": "결정", "delivery": "배송",
    "onboarding": "사용준비", "usage": "사용", "maintenance": "관리", "replacement": "교체",
}

DOMAIN_BY_AXIS = {
    "price_value_fit": "가격 정책", "installation_space_fit": "제품/설치", "maintenance_burden": "운영/서비스",
    "automation_convenience": "UX", "durability_lifespan": "제품 품질", "brand_trust": "메시지/브랜딩",
    "usage_pattern_fit": "제품 기획", "comparison_substitute_judgment": "메시지/포지셔닝",
    "design_interior_fit": "제품 디자인", "service_after_sales": "운영/서비스",
    "purchase_strategy_contract": "정책/계약", "repurchase_recommendation": "CRM/메시지",
}

ACTION_CATALOG = {
    "price_value_fit": ("가격 구조와 번들 구성을 재정비해 진입 장벽을 낮춘다", "가격 대비 가치가 보이도록 등급별 비교 기준을 명확히 제시한다"),
    "installation_space_fit": ("설치 전 공간 적합성 체크와 시각 안내를 기본 프로세스로 넣는다", "설치 제약과 호환 조건을 구매 전 단계에서 명확히 고지한다"),
    "maintenance_burden": ("청소/관리 절차를 단순화하고 리마인드 체계를 도입해 관리 부담을 줄인다", "유지관리 대응 프로세스를 표준화해 처리 시간을 단축한다"),
    "automation_convenience": ("초기 설정 단계를 줄여 핵심 기능까지의 진입 시간을 단축한다", "핵심 UX 흐름에서 이탈을 유발하는 고마찰 단계를 제거한다"),
    "durability_lifespan": ("반복 고장 패턴을 우선 대상으로 신뢰성 개선 과제를 집행한다", "고위험 부품 중심의 사전 품질 점검 항목을 강화한다"),
    "brand_trust": ("신뢰를 떨어뜨리는 접점을 식별해 근거 기반 메시지로 보완한다", "지원 채널과 마케팅 채널의 메시지 일관성을 재정렬한다"),
    "usage_pattern_fit": ("실사용 패턴에 맞춰 기본 기능 설정과 우선순위를 재배치한다", "대표 사용 시나리오 기반으로 모드 추천 가이드를 제공한다"),
    "comparison_substitute_judgment": ("비교 구간에서 핵심 우위 포인트가 한눈에 보이도록 메시지를 재정비한다", "대체 선택지와의 차이를 사용 시나리오 기준으로 명확히 제시한다"),
    "design_interior_fit": ("요청 빈도가 높은 외관 니즈 중심으로 디자인 옵션 구성을 개선한다", "구매 단계에서의 기대 불일치를 줄이도록 비주얼 선택지를 조정한다"),
    "service_after_sales": ("미해결 건에 대한 응답 SLA와 에스컬레이션 기준을 강제한다", "서비스 운영 프로세스를 정비해 수리 리드타임을 단축한다"),
    "purchase_strategy_contract": ("계약 조건을 단순화해 구매 단계의 마찰을 줄인다", "프로모션/할인 규칙을 재구성해 구매 판단의 명확성을 높인다"),
    "repurchase_recommendation": ("재구매 전환을 높이기 위한 메시지 타이밍과 트리거를 정교화한다", "긍정 반응이 실제 재구매로 이어지도록 전환 경로를 설계한다"),
}

POLARITY_GROUP_MAP = {
    "negative": "NEG", "positive": "POS", "mixed": "MIX", "neutral": "NEU",
}

SHEET_AXIS_LABEL = {
    "price_value_fit": "가격부담", "installation_space_fit": "설치불편", "maintenance_burden": "관리부담",
    "automation_convenience": "자동화편의", "durability_lifespan": "내구이슈", "brand_trust": "브랜드신뢰",
    "usage_pattern_fit": "사용적합", "comparison_substitute_judgment": "비교판단", "design_interior_fit": "디자인적합",
    "service_after_sales": "A/S이슈", "purchase_strategy_contract": "구매전략",
    "repurchase_recommendation": "재구매추천",
}

COMPARISON = r"(?iU)\b(?:compare|comparison|vs|versus|instead|rather than|alternative|switch)\b|비교|대체|대신"
GENERIC_SIGNALS = (r"\b(?:thanks|thank you|great video|nice video|lol|lmao)\b", r"^[\W_]+$")
GENERIC_REPRESENTATIVES = r"(?iU)\b(?:thanks|thank you|great video|nice video|lol|lmao|first!|subscribe)\b"
OFF_TOPIC = r"(?iU)\b(?:politics|wife|husband|married|birthday|funny channel)\b"
CONNECTORS = (
    ("contrast", (r"(?iU)\b(?:but|however|though|although)\b", r"(?:하지만|반면|그런데|다만|그러나)", r"(?<=[가-힣])(?:지만)(?=[\s,.;!?]|$)")),
    ("causal", (r"(?iU)\b(?:because|therefore|since)\b", r"(?:때문에|그래서|라서|탓에)")),
    ("conditional", (r"(?iU)\b(?:if only|as long as|if)\b", r"(?:면 좋겠다|으면 좋겠다)", r"(?<=[가-힣])(?:면|으면)(?=[\s,.;!?]|$)")),
    ("additive", (r"(?iU)\b(?:and|also|plus)\b", r"(?:그리고|또한|게다가|및)", r"(?<=[가-힣])도(?=\s+[가-힣A-Za-z])")),
)
EXCLUDED_CATEGORY = {"dryer": (r"(?i)\bhair\s*dryer\b", r"(?i)\bhairdry(?:er)?\b")}
SIGNATURE_NOISE = (
    "general", "usage", "maintenance", "exploration", "awareness", "purchase", "negative", "neutral", "positive", "mixed",
)
