"""Message texts of labelled rows. ``{name}`` parts are filled per row."""

from __future__ import annotations

# Output texts and the labels used in them.

CONTEXT_PREFIX = "맥락을 함께 봤을 때, "
DEFAULT_TARGET_LABEL = "해당 제품"
STRENGTH_LABELS = {"strong": "높은", "medium": "중간", "weak": "약한"}
COMMENT_REASONS = {
    "negative": "{target}에 대한 실제 불만이 명확하게 드러나 부정으로 분류했습니다. 비즈니스 관점에서는 개선 필요 신호가 {strength} 편입니다.",
    "positive": "{target}에 대한 만족감이나 추천 의사가 명확하여 긍정으로 분류했습니다. 비즈니스 관점에서는 강점 신호가 {strength} 편입니다.",
    "comparison": "이 댓글은 {target} 관련 비교나 선호 표현이지만, 명확한 불만은 아니라고 판단해 중립으로 분류했습니다. 비즈니스 관점에서는 {strength} 참고 신호입니다.",
    "preference": "이 댓글은 {target} 에 대한 개인 선호 표현으로, 불만이나 실망이 명확하지 않아 중립으로 분류했습니다.",
    "other": "이 댓글은 {target} 관련 정보 공유 또는 중립적 관찰에 가깝기 때문에 중립으로 분류했습니다.",
}
EXCLUDED_REASON = "제외 댓글로 판단했습니다. 사유: {reason}"
TRASH_REASON = "스팸/무의미 댓글로 판단"
REPRESENTATIVE_REASONS = {
    "strong_candidate": "의미가 명확하고 제품 관련성이 높아, 의사결정자에게 바로 보여줘도 왜 중요한지 이해하기 쉬운 댓글입니다.",
    "review_needed": "의미는 있지만 맥락 의존성이나 해석 보강이 조금 더 필요한 댓글이라, 대표 코멘트로 쓰기 전에 검토가 필요합니다.",
    "not_suitable": "맥락 의존성이 높거나 인사이트가 약해, 대표 코멘트로 바로 제시하기에는 설명력이 부족한 댓글입니다.",
}
INSIGHT_TYPES = {
    "purchase_inquiry": "구매_문의",
    "inquiry": "문의_피드백",
    "conversion": "구매전환_증거",
    "price": "가격_민감",
    "service": "서비스_불만",
    "quality": "품질_불만",
    "satisfaction": "만족_포인트",
    "general": "일반_의견",
}
PRICE_TOPIC_WORDS = ("가격", "비용", "price", "cost")
SERVICE_TOPIC_WORDS = ("수리", "서비스", "as", "repair", "service")
MENTION_TARGETS = {
    "냉장고": "refrigerator", "세탁기": "washer", "건조기": "dryer", "식기세척기": "dishwasher", "드럼": "drum_washer",
    "통돌이": "top_load_washer", "refrigerator": "refrigerator", "fridge": "refrigerator", "washer": "washer",
    "dryer": "dryer", "dishwasher": "dishwasher", "drum": "drum_washer",
}
NEGATION_SAFE = (
    "no issues", "never had any issues", "without issues", "no problem", "never had a problem", "not bad",
    "문제가 없", "고장 없이", "불만은 없",
)
POSITIVE_OVERRIDES = ("never had any issues", "lasted forever", "문제가 없", "고장 없이", "불만은 없")
UNMENTIONED_BRAND = "미언급"
OTHER_TOPIC = "기타"
POLARITY_TITLES = {"negative": "마찰", "positive": "강점", "mixed": "혼합신호", "neutral": "관찰신호"}
INSIGHT_TITLE = "{stage} 단계 · {axis} {polarity}"
INSIGHT_SUMMARIES = {
    "negative": "{stage} 단계에서 '{axis}' 마찰이 반복되어 고객 경험 신호가 집중됩니다. 동일 판단 구조가 {size}건(비중 {share}%) 확인되어 우선 관리 대상입니다.",
    "positive": "{stage} 단계에서 '{axis}' 강점 신호가 누적됩니다. 반복 근거 {size}건(비중 {share}%)으로 확산 가능한 강점 가설입니다.",
    "mixed": "{stage} 단계에서 '{axis}'에 대해 기대와 불만이 동시에 나타납니다. 혼합 신호 {size}건(비중 {share}%)으로 세부 원인 분리가 필요한 구간입니다.",
    "neutral": "{stage} 단계 '{axis}' 신호는 관찰 근거 {size}건(비중 {share}%)입니다. 현재는 반복 구조 {signatures}개로 추세 관찰이 우선입니다.",
}
EVIDENCE_SUMMARY = "동일 신호 {size}건 / 레벨 내 비중 {share}% / 문제 시그니처 {signatures}개 / 영향지표 {impact}"
UNKNOWN_STAGE = "미분류"
TOPIC_INSIGHTS = (
    "{stage} 단계에서 {axis} 이슈가 반복적으로 관찰됩니다 (비중 {coverage}%, 근거 {count}건). {phrase}",
    "{axis} 관련 반응이 {stage} 구간에서 집중되어 나타납니다 (근거 {count}건, 비중 {coverage}%). {phrase}",
    "{stage} 여정에서 {axis} 이슈가 유의미한 비중으로 확인됩니다 (비중 {coverage}%, 근거 {count}건). {phrase}",
)
TOPIC_ACTIONS = (
    "{target} 대상에서는 {domain} 영역의 우선 과제로 '{action}'를 즉시 실행해야 합니다.",
    "{target} 이슈를 줄이기 위해 {domain} 측면에서 '{action}'를 먼저 집행해야 합니다.",
    "{target} 고객경험 개선을 위해 {domain} 축의 핵심 조치로 '{action}'를 바로 추진해야 합니다.",
)
TOPIC_PHRASES = {
    "negative": "부정 반응이 우세합니다",
    "mixed": "기대-현실 간 격차를 시사하는 혼합 반응이 큽니다",
    "positive": "긍정 반응이 우세합니다",
    "other": "반응이 분산되어 추가 확인이 필요합니다",
}
DEFAULT_PRODUCT_TARGET = "핵심 제품군"
DEFAULT_ACTION = "execute a focused corrective plan"
ISSUE_STATES = {"none": "근거 부족", "new": "신규", "up": "상승", "down": "완화", "steady": "지속"}
NEGATIVE_TRENDS = {"none": "추세 데이터 부족", "up": "최근 증가", "down": "최근 감소", "steady": "최근 안정"}
RECURRENCE = ("지속 이슈", "일회성 신호")
REACTIONS = {"negative": "부정 우세", "positive": "긍정 우세", "mixed": "혼합"}
PRIORITY_BUCKETS = ("즉시 관리", "우선 관찰", "모니터링")
STRENGTH_LEVELS = ("높음", "중간", "보통")

# Texts of cards and of video summaries.
SECONDARY_CONCERNS = (
    (("남은시간", "잔여시간", "시간 표시"), "남은시간 표시 가시성이 낮아 사용 중 진행 상태 확인이 어려운 점은 별도 보완 과제로 관리"),
    (("앱 연결", "연결", "wifi", "와이파이"), "앱 연결 안정성 관련 보완 요구가 있어 초기 연결 경험 개선을 병행 검토"),
    (("소음", "시끄"), "전반 만족과 별개로 소음 체감 편차가 있어 사용 환경별 가이드 보완을 검토"),
    (("불편", "아쉽"), "전체 만족은 높지만 일부 사용 불편 포인트가 있어 후속 개선 항목으로 분리 관리"),
)
GENERIC_PHRASES = (
    "실제 불만이 명확하게 드러나", "만족감이나 추천 의사가 명확하여", "비즈니스 관점에서는", "부정으로 분류했습니다", "긍정으로 분류했습니다",
    "중립으로 분류했습니다", "정보 공유 또는 중립적 관찰", "쿠팡 파트너스", "일정액의 수수료", "가격은 구매일자별로", "본 포스팅", "파트너스 활동의 일환",
    "affiliate", "sponsored", "link in description",
)
DEFAULT_CONTEXT = "핵심 맥락"
DEFAULT_SUBJECT = "핵심 사용 경험"
SUBJECT_REASONS = {
    "negative": "부정 포인트: %s 단계에서 %s에 대한 불만이 핵심입니다.",
    "positive": "긍정 포인트: %s 단계에서 %s에 대한 만족감이 핵심입니다.",
    "neutral": "중립 포인트: %s 단계에서 %s 관련 의견이 함께 언급됩니다.",
}
COMMENT_RELEVANCE = {
    "brand": "LG 브랜드 언급", "target": "제품 타깃 매칭", "kind": "의견 유형 신호", "score": "관련성 점수 기반(%.2f)", "none": "관련 근거 부족",
}
MENTION_PARTS = {"negative": "부정: ", "positive": "긍정: ", "any": "혼합: ", "points": "핵심포인트: "}
MENTION_MISSING = {
    "none": "댓글 없음", "invalid": "유효 댓글이 부족해 언급 포인트를 계산하지 못했습니다.", "silent": "핵심 언급을 특정하기 어려워 원문 확인이 필요합니다.",
}
BASIS_MISSING = {"none": "근거 부족", "silent": "핵심 포인트 유사"}
BASIS_POINT = "%s 포인트"
BASIS_NOISE = ("번째", "이거", "이게", "그거", "그게", "진짜", "정말", "너무")
VOC_TOPICS = (
    ("청소 편의", ("easier to clean", "easy to clean"), "예전 제품이 더 청소하기 쉬웠다는 비교가 드러나며 관리 편의에 대한 선호가 읽힙니다."),
    ("내구성", ("lasted forever", "30+ years old", "never had any issues", "never had a problem"), "오랜 사용 기간과 문제 없음이 언급되어 내구성에 대한 강한 인식이 드러납니다."),
    (
        "설계 단순성",
        ("newer isn't always better", "overdesign", "more skus", "unreliable products", "smart crap", "digital buttons", "cpu", "reorder milk", "starve"),
        "과한 기능보다 단순하고 본질적인 설계를 선호하거나, 과설계에 대한 문제의식이 나타납니다.",
    ),
    ("핵심 성능", ("cleaning performance", "washes clothes", "cooling", "temperature", "not cooling", "warmer than", "melted"), "제품의 기본 성능이나 온도 유지, 세척 성능에 대한 평가가 포함됩니다."),
    ("수리/서비스", ("service", "warranty", "tech", "compressor", "board", "repair", "called for service"), "수리 대응, 보증, 서비스 경험에 대한 고객 불만 또는 평가가 포함됩니다."),
    ("가격/비용", ("price increased", "cost", "expensive", "$"), "가격 부담이나 비용 대비 가치 인식이 드러납니다."),
)
VOC_OTHER = ("기타 사용 경험", "제품 관련 경험은 언급되지만, 추가 해석이 필요한 약한 신호입니다.")

# Labels and actions of patterns, by the words they need: all of a set, or any of it.
PATTERN_LABELS = (
    (("rinse", "hot", "cycle"), "린스·온수 사이클 체감 성능 이슈"), (("pod", "powder", "detergent"), "세제 방식(파우더/팟) 사용성·비용 이슈"),
    (("filter", "rinse", "remove"), "필터 관리·세척 냄새 이슈"), (("filter", "smell"), "필터 관리·세척 냄새 이슈"), (("service", "repair"), "A/S·수리 대응 신뢰 이슈"),
)
PATTERN_LABEL_PREFIX, PATTERN_LABEL_NONE = "반복 이슈: ", "반복 이슈"
PATTERN_ACTIONS = (
    (("price", "expensive", "cost", "가격", "비용"), "가격·비용 부담 구간을 우선 점검하고, 대체 옵션 안내를 단기 실행안으로 검토하는 것을 권장합니다."),
    (("filter", "smell", "remove", "maintenance", "관리"), "필터 청소/교체 절차를 단순화하고, 관리 주기 안내를 운영 표준으로 정리하는 방향을 우선 검토하세요."),
    (("rinse", "hot", "cycle", "dry", "세척", "온수"), "린스·온수·사이클 권장 조합을 재점검하고, 사용자 설정 가이드를 명확히 고정하는 방안을 우선 검토하세요."),
    (("repair", "service", "failure", "수리", "서비스"), "재발 빈도가 높은 고장 유형부터 A/S 대응 절차를 점검하고, 처리 우선순위 보강안을 검토하세요."),
)
PATTERN_ACTION_OTHER = "반복 키워드가 가리키는 원인 구간을 좁혀, 즉시 실행 가능한 개선 항목부터 우선 검토하세요."
PATTERN_INSIGHT = "`%s` 축 반응이 현재 범위에서 반복 관찰됩니다 (커버리지 %.3f%%). 핵심 단서 키워드는 `%s`이며, 운영/제품 판단 시 우선 확인할 신호로 볼 수 있습니다."
