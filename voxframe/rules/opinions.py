"""Scene, aspect and inquiry markers for opinion units."""

from __future__ import annotations

# These word lists, patterns and weights must hold for results to be right.
# Every operator takes them as parameters, so other rule tables can be passed in.

INQUIRY_PATTERNS = {
    "HOW_TO": ("how to", "how do i", "사용법", "어떻게", "설정", "방법"),
    "OFFICIAL_SERVICE": ("official service", "service center", "서비스센터", "공식 서비스", "as 센터", "a/s"),
    "RISK_CONCERN": ("safe", "risk", "걱정", "위험", "괜찮을까요", "실수"),
    "WARRANTY": ("warranty", "보증", "무상", "유상"),
    "COST": ("cost", "price", "비용", "가격", "얼마"),
    "ELIGIBILITY": ("eligible", "가능", "대상", "해당", "교환 가능"),
}

SCENE_RULES = (
    (
        "S8 Maintain",
        (
            "repair", "service", "technician", "tech", "warranty", "a/s", "as", "수리", "서비스", "기사", "센터",
            "보증", "점검",
        ),
    ),
    (
        "S5 Deliver",
        ("delivery", "install", "installation", "shipping", "배송", "설치", "파손", "방문", "지연"),
    ),
    (
        "S6 On-board",
        (
            "setup", "set up", "register", "registration", "app", "thinq", "wifi", "연동", "등록", "로그인",
            "초기 설정", "앱",
        ),
    ),
    (
        "S4 Purchase",
        ("bought", "purchase", "purchased", "order", "ordered", "구매", "주문", "결제"),
    ),
    (
        "S9 Replace",
        ("replace", "replaced", "replacement", "교체", "바꿨", "새로 샀"),
    ),
    (
        "S2 Explore",
        ("compare", "comparison", "recommend", "review", "difference", "추천", "비교", "후기", "차이"),
    ),
    (
        "S1 Aware",
        ("ad", "advertisement", "thumbnail", "광고", "썸네일"),
    ),
)

ASPECT_RULES = (
    (
        "Noise/Vibration",
        ("소음", "시끄", "조용", "웅웅", "진동", "떨림", "소리", "쿵쿵", "드르륵", "noise", "vibration", "buzz"),
    ),
    (
        "Performance",
        (
            "세탁력", "때", "오염", "헹굼", "건조", "말림", "세척", "세척력", "잔여물", "흡입", "흡입력", "냉각", "온도", "신선",
            "performance", "cleaning", "cooling", "temperature",
        ),
    ),
    (
        "Convenience/Usability",
        (
            "편해", "불편", "조작", "버튼", "메뉴", "ui", "간편", "복잡", "설정", "convenient", "inconvenient",
            "easy to use",
        ),
    ),
    (
        "Reliability/Breakdown",
        (
            "고장", "불량", "먹통", "안 켜", "작동 안", "에러", "에러코드", "수명", "내구", "broken", "broke", "doesn't work",
            "error", "failed",
        ),
    ),
    (
        "Delivery/Installation",
        ("배송", "설치", "설치기사", "지연", "파손", "시간약속", "delivery", "installation", "shipping"),
    ),
    (
        "App/Connectivity",
        ("앱", "thinq", "와이파이", "연동", "연결", "등록", "로그인", "업데이트", "app", "wifi", "connect", "login"),
    ),
    (
        "Maintenance/Cleaning",
        (
            "관리", "청소", "세척", "필터", "필터 교체", "리셋", "먼지통", "물통", "탈취", "clean", "cleaning", "maintenance",
            "filter",
        ),
    ),
    (
        "A/S & Support",
        (
            "as", "a/s", "서비스센터", "센터", "수리", "접수", "상담", "응대", "처리지연", "불친절", "보증", "수리비", "service",
            "support", "warranty", "repair",
        ),
    ),
    (
        "Price/Value",
        ("가격", "비싸", "가성비", "혜택", "할인", "비용", "구독료", "price", "expensive", "value", "cost"),
    ),
    (
        "Design/Build",
        ("디자인", "마감", "build", "design", "overdesign", "overdesigned", "sku", "simple", "단순", "과설계"),
    ),
    (
        "Safety",
        ("안전", "위험", "safe", "safety", "hazard"),
    ),
    (
        "Energy/Consumption",
        ("전기세", "전력", "소비전력", "효율", "에너지", "energy", "power"),
    ),
    (
        "Smell/Odor",
        ("냄새", "악취", "쿰쿰", "odor", "smell"),
    ),
    (
        "Leakage/Water",
        ("누수", "물샘", "새요", "배수", "역류", "leak", "water"),
    ),
    (
        "Fit/Space",
        ("공간", "크기", "자리", "fit", "space"),
    ),
    (
        "Documentation/Instructions",
        ("설명서", "매뉴얼", "가이드", "manual", "instruction"),
    ),
)

PRODUCT_MAP = {
    "냉장고": "Refrigerator", "세탁기": "Washer", "건조기": "Dryer", "식기세척기": "Dishwasher", "청소기": "Vacuum",
    "오븐": "Oven", "정수기": "Water Purifier", "인덕션": "Induction", "와인셀러": "Wine Cellar", "컵세척기": "Cup Washer",
    "실내식물재배기(틔운)": "Indoor Plant Grower (Tiiun)",
}

# Latin markers per category; the label of a subtype is our own short name.
SUBTYPE_RULES = {
    "Refrigerator": {
        "Side by side": ("side-by-side", "side by side"),
        "Top or bottom freezer": ("top freezer", "bottom freezer", "top-fridge-bottom-freezer"),
        "Kimchi": ("kimchi fridge",),
        "Built-in": ("built-in", "built in"),
        "Mini": ("mini fridge", "personal fridge"),
        "Wine": ("wine cellar", "wine fridge"),
        "Showcase": ("showcase",),
    },
    "Washer": {
        "Front load": ("front loader", "front-load", "drum washer"),
        "Top load": ("top loader", "top-load"),
        "Tower": ("washtower", "wash tower"),
        "Combo": ("combo", "all-in-one", "all in one"),
        "Mini": ("mini washer",),
    },
    "Dryer": {
        "Combo": ("combo", "all-in-one", "all in one", "washer dryer combo"),
        "Heat pump": ("heat pump",),
        "Condenser": ("condenser",),
        "Vented": ("vented",),
    },
    "Dishwasher": {
        "6 place": ("6 place", "6-place"),
        "12-14 place": ("12 place", "14 place", "12-14", "12~14"),
        "Built-in": ("built-in", "built in"),
        "Freestanding": ("freestanding",),
    },
    "Vacuum": {
        "Robot": ("robot", "robot vacuum"),
        "Stick": ("stick", "cordless"),
        "Wet and dry": ("wet&dry", "wet and dry", "w&d"),
        "Handheld": ("handheld",),
    },
    "Cup Washer": {
        "Countertop": ("countertop", "compact"),
        "Built-in": ("built-in", "built in"),
        "Commercial": ("commercial", "cafe", "office"),
    },
    "Indoor Plant Grower (Tiiun)": {
        "Compact": ("compact", "personal"),
        "Stand": ("stand", "stand-type"),
    },
}

CONTRAST = r"(?iU)\b(?:but|however|though|although|while|yet|except)\b|하지만|그런데|다만|반면|근데|그러나"
SENTENCE_END = r"(?<=[.!?])\s+|(?<=。)|\n+"
MODEL_NUMBER = r"(?U)\b[A-Z0-9]{4,}(?:[-_][A-Z0-9]+)*\b"
INTENSE_WORDS = ("진짜", "완전", "너무", "최고", "최악", "절대", "무조건", "always", "never", "worst", "best")
CAUSE_WORDS = ("because", "so ", "때문", "해서", "그래서")
CONDITION_WORDS = ("when", "if ", "할 때", "모드", "설정")
PERIOD_WORDS = ("month", "week", "year", "3개월", "2주", "한달", "매번")
CONTRAST_WORDS = ("than", "compared", "보다", "이전", "전 모델")
DEFAULT_INSIGHT = "대표 의견의 핵심 포인트입니다."
