"""Vocabulary and roles for text mining."""

from __future__ import annotations

# These word lists, patterns and weights must hold for results to be right.
# Every operator takes them as parameters, so other rule tables can be passed in.

STOPWORDS_KO = (
    "그리고", "그러나", "하지만", "그런데", "또한", "정말", "진짜", "너무", "약간", "그냥", "이거", "저거", "이건", "저건", "그거", "여기",
    "거기", "에서", "으로", "에게", "이랑", "같은", "대한", "하는", "하고", "해서", "하면", "입니다", "있어요", "있습니다", "없어요", "없습니다",
    "좋아요", "감사", "감사합니다", "영상", "리뷰", "좋네", "나쁘다", "만들네",
)

STOPWORDS_EN = (
    "the", "a", "an", "and", "as", "or", "but", "if", "to", "of", "for", "in", "on", "at", "by", "with",
    "from", "is", "are", "was", "were", "be", "been", "being", "it", "its", "it's", "this", "that",
    "these", "those", "i", "you", "he", "she", "we", "they", "me", "my", "your", "our", "their", "do",
    "does", "did", "doing", "have", "has", "had", "having", "can", "could", "should", "would", "will",
    "just", "very", "really", "also", "than", "then", "there", "here", "why", "what", "when", "where",
    "which", "who", "how", "all", "one", "ones", "them", "theyre", "you're", "dont", "don't", "cant",
    "can't", "wont", "won't", "im", "i'm", "ive", "i've", "youre", "you've", "well", "like", "use", "used",
    "using", "get", "got", "make", "made", "put", "some", "know", "need", "much", "many", "more", "most",
    "less", "lot", "lots", "thing", "things", "stuff", "good", "great", "nice", "bad", "hand", "people",
    "time", "times", "now", "only", "before", "after", "because", "even", "never", "always", "still",
    "again", "back", "first", "last", "next", "pre", "off", "someone", "anyone", "everyone", "about",
    "into", "out", "up", "down", "so", "too", "not", "no", "yes", "thanks", "thank", "video", "review",
)

NOISE_TOKENS = ("ㅋㅋ", "ㅋㅋㅋ", "ㅋㅋㅋㅋ", "ㅎㅎ", "ㅎㅎㅎ", "ㅠㅠ", "ㅜㅜ", "lol", "lmao", "rofl", "xd")

TOKEN_NORMALIZATION_MAP = {
    "dishwashers": "dishwasher", "dishes": "dish", "pods": "pod", "detergents": "detergent",
    "filters": "filter", "machines": "machine", "washing": "wash", "washes": "wash", "washed": "wash",
    "rinsing": "rinse", "rinses": "rinse", "rinsed": "rinse", "cleaning": "clean", "cleans": "clean",
    "cleaned": "clean", "prices": "price", "costs": "cost", "issues": "issue", "problems": "problem",
}

PRODUCT_TOKENS = (
    "dishwasher", "dish", "machine", "filter", "detergent", "pod", "powder", "liquid", "water", "cycle",
    "laundry", "price", "cost", "performance", "quality", "cleaning", "noise", "service", "repair",
    "delivery", "installation", "design", "maintenance", "가격", "성능", "품질", "세척", "건조", "소음", "설치", "배송",
    "수리", "서비스", "필터", "세제", "냄새", "디자인",
)

ACTION_TOKENS = (
    "wash", "rinse", "clean", "dry", "install", "repair", "replace", "maintain", "remove", "세척", "관리",
    "청소", "교체", "설치", "수리", "사용", "구매",
)

ISSUE_TOKENS = (
    "issue", "problem", "noise", "dirty", "smell", "error", "leak", "broken", "expensive", "burden",
    "delay", "failure", "hot", "문제", "고장", "소음", "불만", "부담", "지연", "오류", "누수",
)

WEAK_DESCRIPTOR_TOKENS = ("clean", "dirty", "hot", "great", "good", "nice", "bad", "좋다", "나쁘다")

ALLOWED_PRODUCT_COMPOUNDS = (
    ("dishwasher", "detergent"),
    ("powder", "detergent"),
    ("liquid", "detergent"),
    ("laundry", "detergent"),
)

ORDERED_ISSUE_TOKENS = ("hot", "dirty", "expensive", "broken")

WEAK_SENTIMENT_KEYWORDS = (
    "good", "great", "nice", "bad", "awesome", "terrible", "okay", "ok", "best", "worst", "좋다", "나쁘다",
)

GENERIC_TOKENS = ("water", "clean", "wash", "dish")

CAUSE_TOKENS = (
    "price", "cost", "expensive", "delay", "installation", "space", "capacity", "detergent", "filter",
    "가격", "부담", "지연", "설치", "공간",
)

SYMPTOM_TOKENS = (
    "problem", "issue", "dirty", "noise", "smell", "error", "leak", "broken", "failure", "hot", "문제", "고장",
    "소음", "누수", "오류",
)

HUB_TOKENS = ("dishwasher", "water", "dish", "wash", "clean")

ABSTRACT_TOKENS = ("issue", "problem")
