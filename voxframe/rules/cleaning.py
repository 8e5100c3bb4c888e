"""Word lists for text quality classes."""

from __future__ import annotations

# These word lists, patterns and weights must hold for results to be right.
# Every operator takes them as parameters, so other rule tables can be passed in.

GENERIC_WORDS = (
    "first", "nice", "great", "good", "lol", "wow", "omg", "thanks", "thank you", "cool", "awesome",
    "amazing", "best", "love it",
)

GENERIC_KO = ("좋아요", "최고", "감사", "감사합니다", "와", "대박", "굿", "ㅋㅋ", "ㅎㅎ", "오")

AD_MARKERS = (
    "promo code", "discount link", "dm me", "telegram", "whatsapp", "http://", "https://", "www.",
)

MEANINGLESS_MARKERS = ("lol", "ㅋㅋ", "ㅎㅎ", "wow", "omg")
