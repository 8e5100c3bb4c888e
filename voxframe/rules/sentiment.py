"""Weighted terms for lexicon sentiment."""

from __future__ import annotations

# These word lists, patterns and weights must hold for results to be right.
# Every operator takes them as parameters, so other rule tables can be passed in.

POSITIVE_TERMS = {
    "좋다": 1.1, "만족": 1.3, "추천": 1.0, "최고": 1.4, "빠르": 0.8, "깔끔": 0.9, "예쁘": 0.8, "감사": 0.6, "편리": 1.1,
    "잘샀": 1.3, "튼튼": 1.1, "조용": 1.1, "성능좋": 1.2, "가성비": 1.0, "믿음": 0.8, "worth it": 1.0, "love": 1.1,
    "great": 0.9,
}

NEGATIVE_TERMS = {
    "별로": 1.0, "불량": 1.6, "최악": 1.7, "느리": 1.0, "불편": 1.3, "문제": 1.1, "소음": 1.2, "발열": 1.1, "실망": 1.5,
    "나쁘": 1.2, "고장": 1.6, "하자": 1.5, "비싸": 0.9, "짜증": 1.4, "누수": 1.5, "환불": 1.2, "반품": 1.2, "불필요": 1.1,
    "쓸데없": 1.3, "복잡": 1.0, "원하지": 1.1, "hate": 1.5, "awful": 1.6, "waste": 1.2, "worthless": 1.3,
}

NEGATION_TERMS = ("안", "못", "않", "없", "never", "no", "not")

INTENSIFIERS = ("너무", "진짜", "정말", "엄청", "완전", "very", "really", "super")

QUESTION_COMPLAINT_PATTERNS = (
    r"why\s+cant", r"why\s+can't", r"\uc65c.+\ubabb", r"\uc65c.+\uc5c6", "can't they just",
    r"\ud544\uc694\s*\uc5c6", r"\uc6d0\ud558\uc9c0\s*\uc54a", r"\ube7c\uace0",
)

POSITIVE_OVERRIDE_PATTERNS = (r"\uac15\ucd94", r"\uc801\uadf9 \ucd94\ucc9c", "very good", "works great", "love it")
